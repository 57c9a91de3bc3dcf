"""Queries over run registries, leaderboards and merged metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from expirylens.operators import audit as A, metrics as M, runs as R
from expirylens.plans import fixtures as X
from expirylens.plans.catalog import query
from expirylens.plans.oracle_parts import sql


def run_rows(spark, d):
    """One run per user, with its configuration spread over the users."""
    e = X.table(spark, d, "events")
    u = F.col("user_id")
    r = e.groupBy("user_id").agg(
        F.count("*").alias("image_count"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 4).alias("final_date_exact_match"),
        F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 4).alias("candidate_recall"),
        F.sum(F.when(F.col("value") > 20, 1).otherwise(0)).alias("candidate_recall_count"),
        F.round(F.avg("value"), 6).alias("ocr_ms_mean"), F.round(F.max("value"), 6).alias("peak_ram_mb"))
    name = F.when(u % 11 == 0, F.concat(F.lit("part_"), u.cast("string"))).otherwise(F.concat(F.lit("run_"), F.lpad(u.cast("string"), 6, "0")))
    return r.select(
        "user_id", name.alias("run"), "image_count", F.when(u % 13 != 0, F.col("final_date_exact_match")).alias("final_date_exact_match"),
        "candidate_recall", (F.col("candidate_recall") / 2).alias("candidate_selection_accuracy"),
        (F.col("ocr_ms_mean") / 1000).alias("sec_per_image"), (1000 / F.col("ocr_ms_mean")).alias("images_per_sec"), "peak_ram_mb",
        F.lit(12.5).alias("model_weight_mb"), F.lit(None).cast("double").alias("detection_ms_mean"), F.lit(None).cast("double").alias("recognition_ms_mean"),
        "ocr_ms_mean", F.when(u % 5 == 0, "/x/data/sample").otherwise(F.concat(F.lit("/x/set_"), (u % 3).cast("string"))).alias("input_dir"),
        F.when(u % 4 == 0, F.concat(F.lit("/ids/dev"), (u % 2 + 1).cast("string"), F.lit("_ids.txt"))).alias("image_ids_path"),
        (u % 3 == 1).alias("tokens_cache_used"), F.when(u % 2 == 0, F.concat(F.lit("EXP"), u.cast("string"))).alias("config_name"),
        F.when(u % 7 == 0, "mock").when(u % 7 < 4, "paddle_mobile_split").otherwise("rapid").alias("ocr_plugin"),
        F.create_map(F.lit("text_detection_model_name"), F.lit("det_a"), F.lit("text_recognition_model_dir"), F.lit("/m/rec_b/"),
                     F.lit("recognition_input_height"), F.when(u % 2 == 0, "48").otherwise("")).alias("ocr_params"),
        F.when(u % 2 == 0, "none").otherwise("clahe").alias("preprocess_plugin"),
        F.create_map(F.lit("allow_day_first"), F.when(u % 2 == 0, "true").otherwise("false"), F.lit("keyword_weight"), F.lit("0.7"),
                     F.lit("sanitization_mode"), F.lit("none")).alias("selector_params")).withColumn("run_name", F.col("run"))


_R = {"rr0": """SELECT user_id, count(*) AS images, round(avg((value > 50)::INT), 4) AS em0, round(avg((value > 20)::INT), 4) AS recall, sum((value > 20)::INT) AS recall_count,
        round(avg(value), 6) AS ocr_ms, round(max(value), 6) AS ram FROM events GROUP BY 1""",
      "rr": """SELECT *, CASE WHEN user_id % 11 = 0 THEN 'part_' || user_id ELSE printf('run_%06d', user_id) END AS run, CASE WHEN user_id % 13 <> 0 THEN em0 END AS em,
        CASE WHEN user_id % 4 = 0 THEN 'dev' || (user_id % 2 + 1) || '_ids' WHEN user_id % 5 = 0 THEN 'sample' ELSE 'set_' || (user_id % 3) END AS test_set,
        CASE WHEN user_id % 11 = 0 THEN 'shard' WHEN user_id % 5 = 0 OR images <= 3 THEN 'smoke' WHEN user_id % 3 = 1 THEN 'cached-ablation' WHEN user_id % 7 = 0 THEN 'mock' ELSE 'fresh-ocr' END AS run_kind FROM rr0"""}
_DESC = """(CASE WHEN user_id % 3 = 1 THEN 'OCR token cache reuse (recognition not re-run)' WHEN user_id % 7 = 0 THEN 'mock OCR fixture (not a real OCR benchmark)'
    WHEN user_id % 7 < 4 THEN 'Paddle split OCR: det=det_a; rec=rec_b' || CASE WHEN user_id % 2 = 0 THEN '; rec_height=48' ELSE '' END ELSE 'OCR=rapid' END)
    || ' | ' || (CASE WHEN user_id % 2 = 0 THEN 'raw image' ELSE 'preprocess=clahe' END) || ' | regex date selector (day-first=' || (CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END)
    || ', keyword=0.7) | date_ko_v1 normalizer'"""


def inventory(spark, d):
    return R.benchmark_inventory(run_rows(spark, d))


@query("l1_classify_run", sql("SELECT run, run_kind, run_kind = 'fresh-ocr' AS rank_eligible FROM rr", **_R))
def l1(spark, d):
    return inventory(spark, d).select("run", "run_kind", "rank_eligible")


@query("l2_test_set_name", sql("SELECT run, test_set FROM rr", **_R))
def l2(spark, d):
    return inventory(spark, d).select("run", "test_set")


@query("t14_describe_architecture", sql(f"SELECT run, {_DESC} AS architecture FROM rr", **_R))
def t14(spark, d):
    return inventory(spark, d).select("run", "architecture")


@query("l3_benchmark_inventory", sql("""SELECT CASE WHEN user_id % 2 = 0 THEN 'EXP' || user_id ELSE run END AS experiment, run_kind, run, images, test_set, em AS final_em, recall AS candidate_recall,
    round(CASE WHEN run_kind <> 'cached-ablation' THEN ocr_ms / 1000 END, 6) AS sec_per_image, CASE WHEN run_kind <> 'cached-ablation' THEN ram END AS peak_ram_mb, ocr_ms FROM rr""", **_R))
def l3(spark, d):
    return inventory(spark, d).select("experiment", "run_kind", "run", "images", "test_set", "final_em", "candidate_recall",
                                      F.round("sec_per_image", 6).alias("sec_per_image"), "peak_ram_mb", "ocr_ms")


@query("l4_rank_within_split", sql("""SELECT run, test_set, row_number() OVER (PARTITION BY test_set ORDER BY em DESC NULLS LAST, run) AS rank FROM rr WHERE run_kind = 'fresh-ocr'""", **_R))
def l4(spark, d):
    return R.rank_within_split(inventory(spark, d)).select("run", "test_set", "rank")


_GROUPS = {"dev": ("dev1_ids", "dev2_ids"), "holdout": ("set_2",)}


@query("l5_best_run_per_group", sql("""SELECT grp AS "group", run, em AS final_em FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY em DESC NULLS LAST, run) AS r FROM (
    SELECT *, CASE WHEN run_kind = 'cached-ablation' THEN 'cached' WHEN run_kind = 'fresh-ocr' AND test_set LIKE 'dev%' THEN 'dev' WHEN run_kind = 'fresh-ocr' AND test_set = 'set_2' THEN 'holdout' END AS grp FROM rr)
    WHERE grp IS NOT NULL) WHERE r = 1""", **_R))
def l5(spark, d):
    return R.best_run_per_group(inventory(spark, d), _GROUPS).select("group", "run", "final_em")


@query("l5_run_kind_counts", sql("SELECT run_kind, count(*) AS count FROM rr GROUP BY 1", **_R))
def l5_counts(spark, d):
    return R.run_kind_counts(inventory(spark, d))


def evidence_rows(spark, d):
    """Evidence of every run; hashes are broken or missing for some."""
    u, r = F.col("user_id"), run_rows(spark, d)
    h = lambda what: F.sha2(F.concat_ws(":", "run", F.lit(what)), 256)
    tier = F.when(u % 10 == 9, "test").otherwise("val")
    prov = F.when(u % 4 == 1, "human").when(u % 4 == 3, "gemini_filtered").otherwise("pseudo")
    rules = R.eligibility_rules(tier, F.when(u % 4 == 2, "human").otherwise(prov), u % 6 == 5)
    return r.select("run", "user_id", F.col("config_name").alias("name"), F.when(u % 17 != 0, "complete").otherwise("started").alias("status"),
                    *[v.alias(k) for k, v in rules.items()], prov.alias("label_provenance"), "image_count", "final_date_exact_match", "sec_per_image",
                    h("m").alias("metrics_sha256"), F.when(u % 8 == 3, "changed").otherwise(h("p")).alias("predictions_sha256"), h("t").alias("tokens_sha256"),
                    F.lit(None).cast("string").alias("invalid"))


def hashes(spark, d):
    r = run_rows(spark, d)
    files = [("m", "metrics.json"), ("p", "predictions.csv"), ("t", "ocr_tokens.jsonl")]
    rows = r.select("run", "user_id", F.explode(F.array(*[F.struct(F.lit(f).alias("file"), F.sha2(F.concat_ws(":", "run", F.lit(k)), 256).alias("sha256")) for k, f in files])).alias("x"))
    return rows.select("run", "user_id", "x.*").filter(~((F.col("file") == "ocr_tokens.jsonl") & (F.col("user_id") % 9 == 4)))


_E = {**_R, "el": """SELECT *, (user_id % 10 <> 9) AND user_id % 4 IN (1, 2, 3) AND user_id % 6 <> 5 AS ok FROM rr""",
      "vr": """SELECT *, CASE WHEN user_id % 17 = 0 THEN 'run_not_complete' WHEN NOT ok THEN 'requires fresh OCR on val with accepted label provenance'
        WHEN user_id % 8 = 3 THEN 'artifact_hash_mismatch:predictions.csv' WHEN user_id % 9 = 4 THEN 'artifact_hash_mismatch:ocr_tokens.jsonl' END AS reason FROM el"""}


@query("l6_verify_evidence", sql("SELECT run, reason FROM vr", **_E))
def l6(spark, d):
    return R.verify_evidence(evidence_rows(spark, d), hashes(spark, d).drop("user_id")).select("run", "reason")


@query("l7_measured_leaderboard", sql("""SELECT run, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY
    CASE WHEN coalesce(em, 0) = 0 THEN -1 ELSE em END DESC, ocr_ms / 1000, CASE WHEN user_id % 2 = 0 THEN 'EXP' || user_id ELSE '' END, run) END AS rank FROM vr""", **_E))
def l7(spark, d):
    return R.measured_leaderboard(R.verify_evidence(evidence_rows(spark, d), hashes(spark, d).drop("user_id"))).select("run", "reason", "rank")


@query("l8_eligibility_rules", sql("""SELECT run, ok AS rank_eligible, CASE WHEN user_id % 4 = 3 THEN 'internal_noisy_label' WHEN user_id % 4 IN (1, 2) THEN 'human_labeled' ELSE 'diagnostic_only' END AS ranking_scope
    FROM el""", **_E))
def l8(spark, d):
    return evidence_rows(spark, d).select("run", "rank_eligible", "ranking_scope")


@query("a25_merge_shards", sql("""SELECT sum(images) AS image_count, round(900.0::DOUBLE / sum(images), 6) AS sec_per_image, round(sum(coalesce(em, 0) * images) / sum(images), 6) AS final_date_exact_match,
    round(sum(recall_count) / sum(images), 6) AS candidate_recall, round(sum(recall / 2 * recall_count) / sum(recall_count), 6) AS candidate_selection_accuracy, max(ram) AS peak_ram_mb FROM rr""", **_R))
def a25(spark, d):
    e = X.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("value") > 20, 1).otherwise(0)).alias("candidate_recall_count"))
    shards = run_rows(spark, d).join(e, "user_id").withColumns({
        "labeled_count": F.col("image_count"), "candidate_recall_denominator": F.col("image_count"),
        "candidate_selection_denominator": F.col("candidate_recall_count")})
    m = M.merge_shards(shards, 900.0)
    return m.select("image_count", *[F.round(c, 6).alias(c) for c in ("sec_per_image", "final_date_exact_match", "candidate_recall", "candidate_selection_accuracy")], "peak_ram_mb")


@query("a26_latency_report", """SELECT count(*) AS images, round(avg((event_type = 'click')::INT), 4) AS exact_match,
    round(sum((event_type = 'click')::INT + (event_type <> 'error')::INT + (value > 50)::INT) / (3.0 * count(*)), 4) AS component_avg, round(avg(value / 1000), 3) AS latency_sec_mean,
    round(quantile_cont(value / 1000, 0.5), 3) AS latency_sec_median, round(quantile_cont(value / 1000, 0.95), 3) AS latency_sec_p95, round(avg(value / 1000) * 500 / 60, 1) AS extrapolated_500_min,
    sum((event_id % 10 = 0)::INT) AS fast_exit_count, sum((event_id % 10 = 0)::INT) AS tier_1, sum((event_id % 10 BETWEEN 1 AND 4)::INT) AS tier_2, sum((event_id % 10 > 4)::INT) AS tier_3 FROM events""")
def a26(spark, d):
    m10 = F.col("event_id") % 10
    rows = X.table(spark, d, "events").select(
        (F.col("value") / 1000).alias("latency_sec"), (F.col("event_type") == "click").alias("em_match"), (F.col("event_type") == "click").alias("year_match"),
        (F.col("event_type") != "error").alias("month_match"), (F.col("value") > 50).alias("day_match"), (m10 == 0).alias("fast_exit"),
        F.when(m10 == 0, 1).when(m10 <= 4, 2).otherwise(3).alias("tier"))
    return M.latency_report(rows)


@query("a31_duplicate_metric_groups", sql("""SELECT em AS final_em, recall AS candidate_recall, recall / 2 AS selection_acc, count(*) AS rows FROM rr GROUP BY 1, 2, 3
    ORDER BY rows DESC, em NULLS FIRST, recall, 3 LIMIT 5""", **_R))
def a31(spark, d):
    return A.duplicate_metric_groups(inventory(spark, d))


@query("a31_rank_sequence_valid", "SELECT true AS rank_sequence_valid")
def a31_rank(spark, d):
    ranked = R.rank_within_split(inventory(spark, d).withColumn("test_set", F.lit("all")))
    return A.rank_sequence_valid(ranked)
