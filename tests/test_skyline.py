"""Parameter searches over the skyline of each image."""

import random

from expirylens.operators import search as Q, selection as S
from expirylens.plans import fixtures as X
from expirylens.plans.storage import materialise
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
KEYS = ["image_id", "tile", "last_tile", "o1", "o2", "o3", "is_correct"]


def both_ways(cands, features, combos, score):
    a = Q.count_correct(cands, features, combos, score)
    b = Q.count_correct(cands, features, combos, score, prune=False)
    a, b = ({r.combo: r.correct for r in x.collect()} for x in (a, b))
    assert a == b and len(a) == len(combos)
    return Q.pruned_work(cands, features, combos, score).first()


def random_cands(spark, features, seed, images=60):
    """Few different values, so that ties and equal rows are common; two images lie in several tiles."""
    r = random.Random(seed)
    rows = []
    for i in range(images):
        for k in range(r.choice((1, 2, 5, 30))):
            last = 2 if i < 2 else 0
            rows.append((f"i{i}", k % (last + 1), last, 0, float(r.randint(0, 1)), k, r.random() < 0.4, *[r.choice((-1.0, 0.0, 0.1, 0.3, 1.0)) for _ in features]))
    return spark.createDataFrame(rows, "image_id string, tile int, last_tile int, o1 int, o2 double, o3 long, is_correct boolean, "
                                 + ", ".join(f"{f} double" for f in features))


def test_random_candidates_and_weights_of_any_sign(spark):
    r = random.Random(3)
    cands = materialise(random_cands(spark, S.FEATURE_COLUMNS, 1))
    for low in (0.0, -1.0):
        combos = [{n: r.choice((low, 0.0, 0.2, 0.7)) for n in S.WEIGHT_NAMES} for _ in range(90)]
        work = both_ways(cands, S.FEATURE_COLUMNS, combos, Q._linear_score)
        assert work.front <= work.candidates and work.evaluated <= work.evaluated_before


def test_scores_of_both_sources(spark):
    r = random.Random(4)
    for score, features, names in (
            (Q._source_score, ["is_yolo", "score", "log_rec", "log_det", "is_due"],
             ["yolo_source", "yolo_bonus", "baseline_source", "candidate_score", "rec_log", "det_log", "due_bonus"]),
            (Q._spatial_score, ["is_yolo", "score", "log_rec", "log_det", "spatial"], ["yolo_bonus", "candidate_score", "rec_log", "det_log", "spatial"])):
        cands = materialise(random_cands(spark, features, 2))
        work = both_ways(cands, features, [{n: r.choice((0.0, 0.5, 1.5)) for n in names} for _ in range(70)], score)
        assert work.front < work.candidates


def test_the_whole_default_grid_on_given_tokens(spark):
    cands = materialise(Q.labelled_candidates(X.features(spark, SF), X.labels(spark, SF)))
    base = S.ScoreParams()
    combos = [{n: c.get(n, getattr(base, n)) for n in S.WEIGHT_NAMES} for c in Q.product_grid(Q.DEFAULT_GRID)]
    assert len(combos) == 7776
    work = both_ways(cands, S.FEATURE_COLUMNS, combos, Q._linear_score)
    assert work.evaluated < work.evaluated_before


def test_one_pass_of_evaluation_and_no_fold_in_a_filter(spark):
    cands = materialise(random_cands(spark, S.FEATURE_COLUMNS, 1, 3))
    combos = [{n: 0.5 for n in S.WEIGHT_NAMES}]
    p = plan(Q.count_correct(cands, S.FEATURE_COLUMNS, combos))
    assert p.count(") MapInPandas") == 1 and all(line.count("exists(") == 0 for line in p.splitlines() if "Condition" in line)


def test_empty(spark):
    cands = random_cands(spark, S.FEATURE_COLUMNS, 1, 1).filter("false")
    combos = [{n: 0.5 for n in S.WEIGHT_NAMES}]
    assert [(r.combo, r.correct) for r in Q.count_correct(cands, S.FEATURE_COLUMNS, combos).collect()] == [(0, 0)]
    assert Q.pruned_work(cands, S.FEATURE_COLUMNS, combos).first().candidates == 0
