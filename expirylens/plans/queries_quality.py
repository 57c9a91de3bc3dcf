"""Queries over label joins, accuracy reports, audits and submission checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from expirylens.operators import audit as A, boxes as B, metrics as M, runs as R, selection as S
from expirylens.operators.filters import review_filter
from expirylens.plans import fixtures as X
from expirylens.plans.catalog import query
from expirylens.plans.oracle_parts import sql
from expirylens.plans.queries_core import _POOL, pool


def evaluation(spark, d):
    return X.stored(spark, d, "evaluation", lambda: M.evaluation_rows(
        X.predictions(spark, d), X.scored(spark, d), X.tokens(spark, d), X.labels(spark, d)))


def review(spark, d):
    return X.stored(spark, d, "review", lambda: M.review_table(
        X.images(spark, d), X.tokens(spark, d), X.scored(spark, d), X.predictions(spark, d)))


def _some_labels(spark, d):
    """Labels of two thirds of the images."""
    return X.label_parts(spark, d).filter(F.substring("image_id", 5, 8).cast("int") % 3 != 0)


# --- joins ---------------------------------------------------------------------------------------

@query("j1_attach_labels", sql("""SELECT p.image_id, p.final_date, coalesce(l.final_date, 'N/A') AS ground_truth, p.final_date = l.final_date AS is_correct
    FROM pred p LEFT JOIN (SELECT * FROM lab WHERE o_orderkey % 3 <> 0) l USING (image_id)""", "pred", "lab"))
def j1(spark, d):
    return M.attach_labels(X.predictions(spark, d), _some_labels(spark, d)).select("image_id", "final_date", "ground_truth", "is_correct")


@query("j2_tokens_with_labels", sql("""SELECT t.image_id, count(*) AS tokens, max(l.final_date) AS target FROM tok t JOIN lab l USING (image_id)
    WHERE l.o_orderkey % 3 <> 0 GROUP BY 1""", "tok", "lab"))
def j2(spark, d):
    return M.tokens_with_labels(X.tokens(spark, d), _some_labels(spark, d)).groupBy("image_id").agg(
        F.count("*").alias("tokens"), F.max("target").alias("target"))


_CHOSEN = {**_POOL, "chosen": """SELECT image_id, prediction, source FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY
    CASE source WHEN 'baseline' THEN 1.0 ELSE 2.0 END + score + 0.4 * ln(greatest(det, 1e-6)) DESC, o, o2, rn) AS r FROM pool) WHERE r = 1""",
    "drive": """SELECT l.image_id, l.final_date AS target, EXISTS (SELECT 1 FROM pool p WHERE p.image_id = l.image_id AND p.prediction = l.final_date) AS candidate_exists,
    coalesce(c.prediction = l.final_date, false) AS selection_exact, c.source AS chosen_source FROM lab l LEFT JOIN chosen c USING (image_id)"""}


def driving(spark, d):
    return M.labels_driving_join(pool(spark, d), X.labels(spark, d), S.diagnose_union_rank(pool(spark, d)))


@query("j3_labels_driving_join", sql("SELECT image_id, target, candidate_exists, selection_exact FROM drive", "sc", "det", "lab", **_CHOSEN))
def j3(spark, d):
    return driving(spark, d).select("image_id", "target", "candidate_exists", "selection_exact")


@query("j4_default_label_join", sql("""SELECT p.image_id, coalesce(l.final_date, 'NONE') AS target_final_date, p.final_date = coalesce(l.final_date, 'NONE') AS em_match,
    p.year = coalesce(l.year, 'NONE') AS year_match, p.month = coalesce(l.month, 'NONE') AS month_match, p.day = coalesce(l.day, 'NONE') AS day_match
    FROM pred p LEFT JOIN (SELECT * FROM labp WHERE o_orderkey % 3 <> 0) l USING (image_id)""", "pred", "labp"))
def j4(spark, d):
    return M.default_label_join(X.predictions(spark, d), _some_labels(spark, d)).select(
        "image_id", "target_final_date", "em_match", "year_match", "month_match", "day_match")


@query("j5_candidates_without_match", sql("""SELECT image_id, target, n_tok AS token_count, n_cand AS candidate_count FROM ev
    WHERE target <> 'NONE' AND NOT covered""", "ev"))
def j5(spark, d):
    return M.candidates_without_match(evaluation(spark, d))


@query("j15_eval_join", sql("""SELECT count(*) AS total_images, sum(ok::INT) AS exact_match, round(avg(ok::INT) * 100, 6) AS exact_match_pct,
    round(avg((py = ly)::INT) * 100, 6) AS year_match_pct, round(avg((pm = lm)::INT) * 100, 6) AS month_match_pct, round(avg((pd = ld)::INT) * 100, 6) AS day_match_pct,
    round(sum((py = ly)::INT + (pm = lm)::INT + (pd = ld)::INT) / (3.0 * count(*)) * 100, 6) AS avg_component_pct FROM ev""", "ev"))
def j15(spark, d):
    s = M.eval_summary(M.eval_join(X.predictions(spark, d), X.label_parts(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("pct") else c for c in s.columns])


@query("j6_coverage_check", sql("""SELECT image_id, 'image' AS missing FROM img WHERE image_id NOT IN (SELECT image_id FROM tok)
    UNION ALL SELECT image_id, 'label' FROM img WHERE o_orderkey % 3 = 0""", "img", "tok"))
def j6(spark, d):
    return A.coverage_check(X.images(spark, d), X.tokens(spark, d), _some_labels(spark, d))


@query("j6_coverage_ready", sql("""SELECT sum((image_id NOT IN (SELECT image_id FROM tok))::INT) AS missing_images, sum((o_orderkey % 3 = 0)::INT) AS missing_labels,
    false AS ready FROM img""", "img", "tok"))
def j6_ready(spark, d):
    return A.coverage_ready(X.images(spark, d), X.tokens(spark, d), _some_labels(spark, d))


@query("j7_id_set_equality", sql("""SELECT sum((o_orderkey % 3 = 0)::INT) AS only_left, 0 AS only_right, 0 AS duplicated_left, 0 AS duplicated_right,
    count(*) AS left_rows, false AS equal FROM img""", "img"))
def j7(spark, d):
    return A.id_set_equality(X.predictions(spark, d), _some_labels(spark, d))


# --- metrics -------------------------------------------------------------------------------------

def _events(spark, d):
    return X.table(spark, d, "events").select(
        F.concat(F.lit("ev_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("image_id"), F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") == "error", "NONE").otherwise("2024-01-01").alias("final_date"), "event_type", "event_id")


_P95 = "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = least(n - 1, greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1))"


@query("a1_run_metrics", f"""SELECT count(*) AS image_count, sum((event_type = 'error')::INT) AS none_count, round(avg((event_type = 'error')::INT), 6) AS none_rate,
    round(avg(value), 6) AS latency_ms_mean, round(quantile_cont(value, 0.5), 6) AS latency_ms_median, ({_P95}) AS latency_ms_p95, 123.5::DOUBLE AS wall_seconds,
    round(123.5::DOUBLE / count(*), 6) AS sec_per_image, round(count(*) / 123.5::DOUBLE, 6) AS images_per_sec FROM events""")
def a1(spark, d):
    m = M.run_metrics(_events(spark, d), 123.5)
    return m.select(*[F.round(c, 6).alias(c) if c not in ("image_count", "none_count", "latency_ms_p95", "wall_seconds") else c for c in m.columns])


@query("a2_percentile_floor", _P95)
def a2(spark, d):
    return M.percentile_floor(_events(spark, d), "elapsed_ms", 0.95, "event_id")


_STG = {"st": """SELECT event_id, CASE event_type WHEN 'click' THEN 'detection_ms' ELSE 'ocr_ms' END AS stage, value AS ms FROM events
    UNION ALL SELECT event_id, 'selection_ms', value / 2 FROM events""",
        "sr": "SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM st"}


@query("a3_stage_latency", sql("""SELECT stage, round(avg(ms), 6) AS mean, max(CASE WHEN i = least(n - 1, greatest(0, CAST(floor(n * 0.95::DOUBLE) AS BIGINT) - 1)) THEN ms END) AS p95
    FROM sr GROUP BY stage""", **_STG))
def a3(spark, d):
    v = F.col("elapsed_ms")
    e = _events(spark, d).select("image_id", F.when(F.col("event_type") == "click", v).alias("detection_ms"),
                                 F.when(F.col("event_type") != "click", v).alias("ocr_ms"), (v / 2).alias("selection_ms"))
    return M.stage_latency(e, ("detection_ms", "ocr_ms", "selection_ms")).select("stage", F.round("mean", 6).alias("mean"), "p95")


@query("a4_accuracy_metrics", sql("""SELECT count(*) AS labeled_count, round(avg(ok::INT), 6) AS final_date_exact_match,
    sum((target <> 'NONE' AND covered)::INT) AS candidate_recall_count, sum((target <> 'NONE')::INT) AS candidate_recall_denominator,
    round(sum((target <> 'NONE' AND covered)::INT) / sum((target <> 'NONE')::INT), 6) AS candidate_recall,
    round(sum((target <> 'NONE' AND covered AND ok)::INT) / sum((target <> 'NONE' AND covered)::INT), 6) AS candidate_selection_accuracy,
    sum((target <> 'NONE' AND covered)::INT) AS candidate_selection_denominator,
    round(sum((target <> 'NONE' AND predicted <> 'NONE' AND py = ly)::INT) / sum((target <> 'NONE')::INT), 6) AS year_accuracy,
    round(sum((target <> 'NONE' AND predicted <> 'NONE' AND pm = lm)::INT) / sum((target <> 'NONE')::INT), 6) AS month_accuracy,
    round(sum((target <> 'NONE' AND predicted <> 'NONE' AND pd = ld)::INT) / sum((target <> 'NONE')::INT), 6) AS day_accuracy FROM ev""", "ev"))
def a4(spark, d):
    m = M.accuracy_metrics(evaluation(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if "count" not in c and "denominator" not in c else c for c in m.columns])


_CAT = """CASE WHEN ok THEN '' WHEN target = 'NONE' THEN 'AMBIGUOUS / UNKNOWN' WHEN covered THEN 'SEL' WHEN n_tok = 0 THEN 'DET'
    WHEN (SELECT count(*) FROM dt WHERE dt.image_id = ev.image_id AND form <> 4) > 0 THEN 'GEN' ELSE 'REC' END"""


@query("a5_error_category", sql(f"SELECT image_id, {_CAT} AS error_category FROM ev", "ev"))
def a5(spark, d):
    return evaluation(spark, d).select("image_id", M.error_category().alias("error_category"))


@query("a6_error_category_counts", sql(f"""SELECT error_category, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS ratio
    FROM (SELECT {_CAT} AS error_category FROM ev) WHERE error_category <> '' GROUP BY 1""", "ev"))
def a6(spark, d):
    return M.error_category_counts(evaluation(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("a7_recognition_metrics", """SELECT 'available' AS status, round(sum(levenshtein(c_name, c_mktsegment)) / sum(greatest(1, length(c_mktsegment))), 6) AS cer,
    0.0::DOUBLE AS exact_string_accuracy, count(*) AS labeled_count FROM customer""")
def a7(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_name").alias("ocr_text"), F.col("c_mktsegment").alias("truth_text"))
    return M.recognition_metrics(c).withColumn("cer", F.round("cer", 6))


@query("a8_review_table", sql("""SELECT i.image_id, coalesce(t.ocr_text, '') AS ocr_text, coalesce(t.n, 0) AS token_count, coalesce(c.n, 0) AS candidate_count,
    coalesce(c.candidate_set, '') AS candidate_set, coalesce(p.raw_text, 'NONE') AS candidate, p.final_date AS selected_candidate_normalized, p.final_date
    FROM img i JOIN pred p USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n, string_agg(text, ' | ' ORDER BY token_index) AS ocr_text FROM tok GROUP BY 1) t USING (image_id)
    LEFT JOIN (SELECT image_id, count(*) AS n, string_agg(iso, ' | ' ORDER BY rank) AS candidate_set FROM ranked GROUP BY 1) c USING (image_id)""",
    "img", "pred", "tok", "ranked"))
def a8(spark, d):
    return review(spark, d).select("image_id", "ocr_text", "token_count", "candidate_count", "candidate_set", "candidate",
                                   "selected_candidate_normalized", "final_date")


@query("f12_review_filter", sql("SELECT image_id FROM ev WHERE NOT ok AND (predicted LIKE '%-03-%' OR target LIKE '%-03-%')", "ev"))
def f12(spark, d):
    """Failures that mention March; the texts themselves write dates in other ways."""
    r = M.attach_labels(review(spark, d), X.labels(spark, d))
    return review_filter(r, "fail", "-03-").select("image_id")


@query("l9_failure_samples", sql("SELECT image_id, target AS ground_truth, predicted AS final_date FROM ev WHERE NOT ok ORDER BY image_id LIMIT 10", "ev"))
def l9(spark, d):
    r = M.attach_labels(review(spark, d), X.labels(spark, d))
    return R.failure_samples(r, 10).select("image_id", "ground_truth", "final_date")


@query("a15_selection_stress", sql("""SELECT count(*) AS image_count, sum(ok::INT) AS correct_count, round(avg(ok::INT), 6) AS selection_accuracy FROM ev
    WHERE target <> 'NONE' AND covered AND n_cand >= 2""", "ev"))
def a15(spark, d):
    return M.selection_stress(evaluation(spark, d)).withColumn("selection_accuracy", F.round("selection_accuracy", 6))


_SRC = {**_CHOSEN, "cat": """SELECT l.image_id, CASE WHEN b.hit AND y.hit THEN 'both_cover' WHEN b.hit THEN 'baseline_only_cover' WHEN y.hit THEN 'detector_only_cover'
    WHEN b.hit IS NULL AND y.hit IS NULL THEN 'no_candidate_both' WHEN b.hit IS NULL THEN 'baseline_empty_detector_wrong'
    WHEN y.hit IS NULL THEN 'detector_empty_baseline_wrong' ELSE 'both_wrong_candidate' END AS source_category FROM lab l
    LEFT JOIN (SELECT p.image_id, bool_or(p.prediction = l.final_date) AS hit FROM pool p JOIN lab l USING (image_id) WHERE source = 'baseline' GROUP BY 1) b USING (image_id)
    LEFT JOIN (SELECT p.image_id, bool_or(p.prediction = l.final_date) AS hit FROM pool p JOIN lab l USING (image_id) WHERE source = 'yolo' GROUP BY 1) y USING (image_id)"""}


@query("a16_union_bottleneck", sql("""SELECT 'source_category' AS kind, source_category AS name, count(*) AS count FROM cat GROUP BY ALL
    UNION ALL SELECT 'ranking_error', chosen_source, count(*) FROM drive WHERE candidate_exists AND NOT selection_exact GROUP BY ALL""", "sc", "det", "lab", **_SRC))
def a16(spark, d):
    return M.union_bottleneck(M.source_categories(pool(spark, d), X.labels(spark, d)), driving(spark, d))


@query("a17_union_diagnostics", sql("""SELECT count(*) AS images, round(avg(candidate_exists::INT), 6) AS candidate_recall,
    round(sum(selection_exact::INT) / greatest(1, sum(candidate_exists::INT)), 6) AS selection_accuracy_given_candidate, round(avg(selection_exact::INT), 6) AS final_em
    FROM drive""", "sc", "det", "lab", **_CHOSEN))
def a17(spark, d):
    m = M.union_diagnostics(driving(spark, d))
    return m.select("images", *[F.round(c, 6).alias(c) for c in m.columns if c != "images"])


# --- audits --------------------------------------------------------------------------------------

def audited(spark, d):
    return X.stored(spark, d, "audited", lambda: A.audit_labels(
        X.noisy_labels(spark, d), _some_labels(spark, d).filter("final_date <> 'NONE'"), X.tokens(spark, d)))


_AUD = {"au": r"""SELECT n.image_id, n.k, n.year, n.month, n.day, n.final_date, n.final_date = 'NONE' AS is_none,
    n.final_date <> 'NONE' AND regexp_full_match(n.final_date, '\d{4}-\d{2}-\d{2}') AS shaped, try_cast(n.final_date AS DATE) AS real_date,
    g.final_date AS gt, t.all_text FROM noisy n
    LEFT JOIN (SELECT * FROM labp WHERE final_date <> 'NONE' AND o_orderkey % 3 <> 0) g USING (image_id)
    LEFT JOIN (SELECT image_id, string_agg(text, ' ' ORDER BY token_index) AS all_text FROM tok GROUP BY 1) t USING (image_id)""",
    "av": r"""SELECT *, regexp_replace(all_text, '[^0-9A-Za-z가-힣]', '', 'g') AS packed FROM au""",
    "aw": """SELECT *, all_text IS NOT NULL AND NOT is_none AS tok_checked, contains(packed, year || month || day) OR contains(packed, year[3:4] || month || day)
        OR contains(packed, day || month || year) OR contains(packed, day || month || year[3:4])
        OR (contains(all_text, year) AND contains(all_text, month) AND contains(all_text, day)) AS found FROM av""",
    "fl": """SELECT *, list_filter([CASE WHEN image_id = '' THEN 'MISSING_IMAGE_ID' END,
        CASE WHEN is_none AND (year <> 'NONE' OR month <> 'NONE' OR day <> 'NONE') THEN 'FINAL_NONE_BUT_COMPONENTS_SET' END,
        CASE WHEN NOT is_none AND NOT shaped THEN 'INVALID_DATE_FORMAT' END,
        CASE WHEN shaped AND final_date <> year || '-' || month || '-' || day THEN 'COMPONENT_MISMATCH' END,
        CASE WHEN shaped AND real_date IS NULL THEN 'CALENDAR_INVALID' END,
        CASE WHEN shaped AND real_date IS NOT NULL AND year(real_date) NOT BETWEEN 2018 AND 2035 THEN 'YEAR_OUTLIER' END,
        CASE WHEN gt IS NOT NULL AND gt <> final_date THEN 'GT_MISMATCH' END,
        CASE WHEN tok_checked AND NOT found THEN 'OCR_HALLUCINATION_OR_MISSING' END], lambda x: x IS NOT NULL) AS types FROM aw"""}


@query("a18_audit_labels", sql("SELECT image_id, final_date, year, array_to_string(types, '|') AS flag_types, len(types) AS num_flags, len(types) = 0 AS is_clean FROM fl",
                               "noisy", "labp", "tok", **_AUD))
def a18(spark, d):
    return audited(spark, d).select("image_id", "final_date", "year", F.array_join("flag_types", "|").alias("flag_types"), "num_flags", "is_clean")


@query("a19_token_evidence", sql("""SELECT image_id, final_date, count(*) FILTER (tok_checked AND found) AS found FROM aw WHERE tok_checked GROUP BY ALL""", "noisy", "labp", "tok", **{k: v for k, v in _AUD.items() if k != "fl"}))
def a19(spark, d):
    a = audited(spark, d).filter("token_checked")
    return a.groupBy("image_id", "final_date").agg(F.sum(F.when(F.col("token_found"), 1).otherwise(0)).alias("found"))


@query("a20_audit_summary", sql("""SELECT count(*) AS total_images, sum((len(types) = 0)::INT) AS clean_count, round(avg((len(types) = 0)::INT) * 100, 2) AS clean_ratio,
    sum((len(types) > 0)::INT) AS flagged_count, round(avg((len(types) > 0)::INT) * 100, 2) AS flagged_ratio,
    sum((shaped AND real_date IS NOT NULL)::INT) AS valid_dates, sum(is_none::INT) AS none_dates,
    sum(len(list_filter(types, lambda x: x IN ('MISSING_IMAGE_ID','FINAL_NONE_BUT_COMPONENTS_SET','INVALID_DATE_FORMAT','COMPONENT_MISMATCH')))) AS syntax_errors,
    sum(list_contains(types, 'CALENDAR_INVALID')::INT) AS calendar_errors, sum(list_contains(types, 'YEAR_OUTLIER')::INT) AS domain_year_outliers,
    sum((gt IS NOT NULL)::INT) AS gt_evaluated, sum(coalesce(gt = final_date, false)::INT) AS gt_exact_matches, sum(coalesce(gt <> final_date, false)::INT) AS gt_mismatches,
    sum(tok_checked::INT) AS token_evaluated, sum((tok_checked AND NOT found)::INT) AS token_hallucinations, sum((tok_checked AND found)::INT) AS token_confirmed FROM fl""",
    "noisy", "labp", "tok", **_AUD))
def a20(spark, d):
    return A.audit_summary(audited(spark, d))


@query("a20_audit_breakdown", sql("""SELECT 'flag' AS kind, t AS name, count(*) AS count FROM (SELECT unnest(types) AS t FROM fl) GROUP BY ALL
    UNION ALL SELECT 'year', CAST(year(real_date) AS VARCHAR), count(*) FROM fl WHERE shaped AND real_date IS NOT NULL GROUP BY ALL""", "noisy", "labp", "tok", **_AUD))
def a20b(spark, d):
    return A.audit_breakdown(audited(spark, d))


@query("a21_pseudo_labels", sql("""SELECT image_id, final_date, printf('%.4f', conf) AS confidence, CASE WHEN positive > 0 THEN 'high_conf_keyword' ELSE 'high_conf_direct_stamp' END AS rule,
    raw_text FROM pred WHERE final_date <> 'NONE' AND conf >= 0.85""", "pred"))
def a21(spark, d):
    return B.pseudo_labels(X.selected(spark, d), X.predictions(spark, d)).select("image_id", "final_date", "confidence", "rule", "raw_text")


@query("a22_pseudo_label_agreement", sql("""SELECT sum((p.final_date = l.final_date)::INT) AS matched, sum((l.final_date <> 'NONE')::INT) AS with_truth,
    round(sum((p.final_date = l.final_date)::INT) / sum((l.final_date <> 'NONE')::INT) * 100, 6) AS agreement_pct
    FROM pred p JOIN lab l USING (image_id) WHERE p.final_date <> 'NONE' AND p.conf >= 0.85 AND l.o_orderkey % 3 <> 0""", "pred", "lab"))
def a22(spark, d):
    p = B.pseudo_labels(X.selected(spark, d), X.predictions(spark, d))
    return B.pseudo_label_agreement(p, _some_labels(spark, d)).withColumn("agreement_pct", F.round("agreement_pct", 6))


def numbered(spark, d):
    """Submission rows with the line they have in a file ordered by order key."""
    return A.numbered_lines(X.noisy_labels(spark, d).filter("image_id <> ''"), "image_id")


_LINES = {"ln": "SELECT *, row_number() OVER (ORDER BY image_id) + 1 AS line FROM noisy WHERE image_id <> ''"}


@query("a23_submission_check_strict", sql("""SELECT count(*) AS rows, sum(bad::INT) AS violations, min(CASE WHEN bad THEN line END) AS first_bad_line, false AS is_empty FROM (
    SELECT *, month = '13' OR (year = 'NONE' AND day <> 'NONE') OR (k = 5 AND final_date <> 'NONE') OR k = 4 AND final_date <> 'NONE' AS bad FROM ln)""", "noisy", **_LINES))
def a23(spark, d):
    return A.submission_check_strict(numbered(spark, d)).select("rows", "violations", "first_bad_line", "is_empty")


@query("a24_submission_check_lenient", sql("""SELECT line, CASE WHEN final_date = 'NONE' THEN 'final_date is NONE but year/month/day is not NONE' WHEN k = 4 THEN 'invalid final_date format'
    ELSE 'final_date does not match components' END AS message, count(*) OVER () AS total FROM ln WHERE (final_date = 'NONE' AND day <> 'NONE') OR (k = 4 AND final_date <> 'NONE')
    OR (final_date <> 'NONE' AND k <> 4 AND final_date <> year || '-' || month || '-' || day)""", "noisy", **_LINES))
def a24(spark, d):
    return A.submission_check_lenient(numbered(spark, d))


# --- reports over recogniser output --------------------------------------------------------------

@query("a27_crop_eval", sql("SELECT count(*) AS samples, round(avg((form IN (0, 1, 3) OR form = 2 AND year(d) = 2020 AND day(d) = 20)::INT), 6) AS exact, round(60.0::DOUBLE / count(*), 9) AS sec_per_image FROM dt", "dt"))
def a27(spark, d):
    rows = X.dated_lines(spark, d).select(
        X.date_text(F.col("rn"), F.col("d")).alias("raw"), F.date_format("d", "yyyy-MM-dd").alias("label"))
    m = M.crop_eval(rows, 60.0)
    return m.select("samples", F.round("exact", 6).alias("exact"), F.round("sec_per_image", 9).alias("sec_per_image"))


@query("a28_detector_eval", sql("""SELECT count(*) AS valid_images, round(avg(coalesce(r.hit, false)::INT), 6) AS candidate_recall,
    round(avg(coalesce(c.prediction = l.final_date, false)::INT), 6) AS selection_accuracy, round(avg(coalesce(c.prediction = l.final_date, false)::INT), 6) AS final_em
    FROM lab l LEFT JOIN (SELECT d.image_id, bool_or(coalesce(d.prediction = l.final_date, false)) AS hit FROM det d JOIN lab l USING (image_id) GROUP BY 1) r USING (image_id)
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (class = 1) DESC, rec_score * det_conf DESC, candidate_index) AS q FROM det) WHERE q = 1) c USING (image_id)
    WHERE l.final_date <> 'NONE'""", "det", "lab"))
def a28(spark, d):
    m = M.detector_eval(X.detector(spark, d), X.labels(spark, d))
    return m.select("valid_images", *[F.round(c, 6).alias(c) for c in m.columns if c != "valid_images"])


@query("a29_status_counts", sql("SELECT class, name, count(*) AS count FROM box GROUP BY ALL", "box"))
def a29(spark, d):
    return M.counts_by(X.boxes(spark, d), "class", "name")


_MISS = {"mi": """SELECT e.image_id, count(d.image_id) AS n, count(d.prediction) AS p FROM ev e LEFT JOIN det d USING (image_id)
    WHERE target <> 'NONE' AND NOT covered GROUP BY 1"""}


@query("a37_candidate_miss_breakdown", sql("""SELECT CASE WHEN n = 0 THEN 'no_detector_box' WHEN p = 0 THEN 'box_without_date_text' ELSE 'other_date_only' END AS reason,
    count(*) AS images FROM mi GROUP BY 1""", "ev", "det", **_MISS))
def a37(spark, d):
    return B.candidate_miss_breakdown(evaluation(spark, d), X.detector(spark, d))

