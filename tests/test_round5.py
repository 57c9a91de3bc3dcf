from pyspark.sql import functions as F

from conftest import TOKENS
from expirylens.operators import candidates as C, selection as S
from expirylens.plans.storage import materialise

TEXTS = ["2024.01.02", "EXP", "03/04/2024", "20250506", "LOT", "07AUG2026", "2024.01.02"]


def exchanges(df):
    plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[1].count("Exchange hashpartitioning")


def table(spark, indexes):
    """Image a has the given token positions, image b one keyword, image c none."""
    box = (0.0, 0.0, 40.0, 10.0)
    rows = [("a", i, TEXTS[n % len(TEXTS)], 0.9, 0.8, (10.0 * (n % 3), 12.0 * (n % 5), 60.0, 70.0), "baseline") for n, i in enumerate(indexes)]
    rows += [("b", i, t, 0.9, 0.8, box, "yolo") for i, t in enumerate(["EXP", "2024.01.02", "2025.01.02"])]
    rows += [("c", i, t, 0.9, 0.8, box, None) for i, t in enumerate(["2024.01.02", "12-03", "LOOK"])]
    return materialise(spark.createDataFrame(rows, TOKENS))


def canonical(df):
    return sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())


def test_features_shuffle_candidates_once(spark):
    tokens = table(spark, range(7))
    cands = C.extract_candidates(tokens, True, True, materialise=materialise, by_text=True)
    feats = S.features(cands, tokens)
    assert exchanges(feats) <= 2        # the candidates, and where they are not broadcast the keywords


def test_features_of_one_and_several_tiles_and_blocks(spark):
    for indexes in (range(7), [0, 1, 2, 3, 4096, 4097, 9000], [0, 1, 2, 3, 1500, 1501, 5000, 5001, 9001]):
        tokens = table(spark, indexes)
        cands = C.extract_candidates(tokens, True, True, materialise=materialise, by_text=True)
        got = S.context_features(cands, tokens)
        want = S.context_features(cands, tokens, extremes=S.date_extremes(cands))
        tiles = got.columns
        assert canonical(got) == canonical(want.select(*tiles))
        assert got.count() == cands.count()


def test_tokens_meet_a_stored_dictionary_without_a_shuffle(spark):
    tokens = table(spark, range(7))
    found = C.token_candidates(tokens, True, True, by_text=True, materialise=materialise)
    assert exchanges(found) == 0
    assert canonical(found) == canonical(C.token_candidates(tokens, True, True))


def test_pool_of_one_tile_is_no_shuffle(spark):
    from expirylens.operators.search import union_pool
    cols = "image_id string, prediction string, source string, score double, rec double, det double, class int, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    row = ("a", "2024-01-02", "baseline", 1.0, 0.9, 0.8, 1, (0.0, 0.0, 1.0, 1.0))
    baseline = materialise(spark.createDataFrame([(*row, 1 << 20)], cols + ", cand_ordinal long"))
    large = materialise(spark.createDataFrame([(*row, 1 << 20), (*row, 5000 << 20)], cols + ", cand_ordinal long"))
    detector = materialise(spark.createDataFrame([(*row, 3)], cols + ", candidate_index int"))
    assert exchanges(union_pool(baseline, detector)) == 0
    assert [r.last_tile for r in union_pool(baseline, detector).collect()] == [0, 0]
    assert [r.last_tile for r in union_pool(large, detector).collect()] == [1, 1, 1]


def test_images_are_evaluated_in_one_pass(spark):
    from expirylens.operators.search import count_correct
    weights = dict.fromkeys(S.WEIGHT_NAMES, 1.0)
    rows = []
    for image, right in (("all", (1, 1)), ("no", (0, 0)), ("some", (0, 1))):      # two settled images and an open one
        rows += [(image, 0, 0, 0, 0.0, i, r > 0, *[float(i)] * len(S.FEATURE_COLUMNS)) for i, r in enumerate(right)]
    cands = materialise(spark.createDataFrame(rows, "image_id string, tile int, last_tile int, o1 int, o2 double, o3 long, is_correct boolean, "
                                              + ", ".join(f"{n} double" for n in S.FEATURE_COLUMNS)))
    out = count_correct(cands, S.FEATURE_COLUMNS, [weights, {n: -1.0 for n in S.WEIGHT_NAMES}])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.correct for r in out.collect()) == [1, 2]
