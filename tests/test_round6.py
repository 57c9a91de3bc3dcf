from pyspark.sql import functions as F

from expirylens.functions import dates as D
from expirylens.functions.text import WS_CHARS
from expirylens.operators import audit as A, candidates as C, metrics as M, normalize as N, selection as S
from expirylens.plans.storage import materialise
from test_round5 import canonical, exchanges, table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def marked(spark, indexes):
    tokens = table(spark, indexes)
    cands = C.extract_candidates(tokens, True, True, materialise=materialise, by_text=True)
    return tokens, materialise(S.mark_leading(S.features(cands, tokens), one_tile=max(indexes) < 4096))


def test_marked_rows_are_the_selection(spark):
    for indexes in (range(7), [0, 1, 2, 3, 4096, 4097, 9000]):
        _, feats = marked(spark, indexes)
        got = S.best_candidates(feats)
        want = S.select_best(S.score_candidates(feats.drop("leads")))
        assert canonical(got) == canonical(want)


def test_selection_from_stored_features_sorts_nothing(spark):
    _, feats = marked(spark, range(7))
    plan = plan_of(S.best_candidates(feats))
    assert "Sort" not in plan and "Exchange" not in plan and "Window" not in plan


def test_candidates_meet_labels_with_one_shuffle(spark):
    for indexes in (range(7), [0, 1, 2, 3, 4096, 4097, 9000]):
        tokens, feats = marked(spark, indexes)
        scored = S.score_candidates(feats.drop("leads"))
        images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image_id string")
        predictions = materialise(N.normalize_prediction(S.select_best(scored, images)))
        labels = materialise(spark.createDataFrame([("a", "2026-08-07"), ("b", "2020-01-01"), ("c", " 2024-01-02"), ("d", "NONE")],
                                                   "image_id string, final_date string"))
        rows = M.evaluation_rows(predictions, scored, tokens, labels)
        if indexes == range(7):
            assert exchanges(rows) <= 4     # labels, candidates, tokens and predictions, each once
        got = {r.image_id: (r.covered, r.candidate_count, r.token_count) for r in rows.collect()}
        counts = {r.image_id: r["count"] for r in scored.groupBy("image_id").count().collect()}
        assert got == {"a": (True, counts["a"], 7), "b": (False, counts["b"], 3), "c": (True, counts["c"], 3), "d": (False, 0, 0)}


def test_cheap_trims_equal_the_full_one(spark):
    cores = ["", "a", "2024.01.02", "2024년 01월 02일", "가", "é", "2024-01-02", "none-01-02", "NONE", "None", "2024-01-None", "1-2-2024", "​7"]
    texts = [a + c + b for c in cores for a in ("", *WS_CHARS[:4], WS_CHARS[-1]) for b in ("", *WS_CHARS[:4], WS_CHARS[-1])]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    t = df.select(F.expr(D.trimmed_sql("t")).alias("a"), F.expr(D.trim_sql("t")).alias("b"))
    assert t.filter("NOT a <=> b").count() == 0
    u = df.withColumn("u", F.expr(D.trim_sql("t"))).select(D.parse_final_date("t").alias("c"), D.parse_final_date("u").alias("d"))
    assert u.filter("NOT c <=> d").count() == 0
    assert u.filter("c IS NOT NULL").count() > 0


def test_audit_flags_are_compiled(spark):
    rows = [("a", "2024", "01", "02", "2024-01-02"), ("", "2024", "1", "02", "2024-01-02"), ("b", "2024", "02", "30", "2024-02-30"),
            ("c", "1990", "01", "01", "1990-01-01"), ("d", "NONE", "01", "NONE", "NONE"), ("e", "x", None, "", "2024/01/02"), ("f", "2024", "05", "06", "2024-05-06")]
    labels = spark.createDataFrame(rows, "image_id string, year string, month string, day string, final_date string")
    truth = spark.createDataFrame([("a", "2024-01-02"), ("f", "2024-05-07")], "image_id string, final_date string")
    out = A.audit_labels(labels, truth)
    plan = plan_of(out)
    assert "transform(" not in plan
    got = {r.image_id: (r.flag_types, r.flags, r.num_flags, r.is_clean, r.is_real, r.year_value) for r in out.collect()}
    assert got["a"] == ([], "", 0, True, True, 2024)
    assert got[""][0] == ["MISSING_IMAGE_ID", "COMPONENT_MISMATCH"]
    assert got[""][1] == "MISSING_IMAGE_ID | COMPONENT_MISMATCH: final(2024-01-02) != (2024-1-02)"
    assert got["b"] == (["CALENDAR_INVALID"], "CALENDAR_INVALID: not a calendar date", 1, False, False, None)
    assert got["c"] == (["YEAR_OUTLIER"], "YEAR_OUTLIER: 1990 not in [2018, 2035]", 1, False, True, 1990)
    assert got["d"][0] == ["FINAL_NONE_BUT_COMPONENTS_SET"]
    assert got["e"][0] == ["INVALID_DATE_FORMAT"]
    assert got["f"][0] == ["GT_MISMATCH"] and got["f"][1].startswith("GT_MISMATCH: 2024-05-06 vs GT 2024-05-07 [")
