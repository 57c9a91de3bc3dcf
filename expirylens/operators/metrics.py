"""Accuracy, latency and error reports over predictions, candidates and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.functions.dates import (candidate_final_date, final_date_sql, normalize_validated,
                                        normalize_simple, prediction_matches)
from expirylens.functions.text import is_dateish
from expirylens.operators.filters import last_per_id
from expirylens.operators.ordering import in_one_tile, with_global_index
from expirylens.operators.selection import candidate_tile, detector_choice


def ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def _share(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


# --- joins with labels ---------------------------------------------------------------------------

def attach_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of labels; ground_truth N/A and is_correct null where there is no label."""
    j = predictions.join(last_per_id(labels).select("image_id", F.col("final_date").alias("__t")), "image_id", "left")
    return (j.withColumn("is_correct", F.when(F.col("__t").isNotNull(), prediction_matches("final_date", "__t")))
            .withColumn("ground_truth", F.coalesce("__t", F.lit("N/A"))).drop("__t"))


def tokens_with_labels(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    return tokens.join(last_per_id(labels).select("image_id", F.col("final_date").alias("target")), "image_id")


def default_label_join(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Every prediction with its label; a missing label counts as all NONE. Plain string matches."""
    none = F.lit("NONE")
    t = last_per_id(labels).select("image_id", *[F.col(c).alias(f"target_{c}") for c in ("year", "month", "day", "final_date")])
    j = predictions.join(t, "image_id", "left")
    return j.withColumns({f"target_{c}": F.coalesce(f"target_{c}", none) for c in ("year", "month", "day", "final_date")}
                         ).withColumns({f"{n}_match": F.coalesce(F.col(c) == F.col(f"target_{c}"), F.lit(False))
                                        for n, c in (("year", "year"), ("month", "month"), ("day", "day"),
                                                     ("em", "final_date"))})


def eval_join(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join with per-component matches."""
    t = last_per_id(labels).select("image_id", *[F.col(c).alias(f"{c}_gt") for c in ("year", "month", "day", "final_date")])
    return predictions.join(t, "image_id").withColumns({
        f"{c}_match": F.col(c) == F.col(f"{c}_gt") for c in ("year", "month", "day", "final_date")})


def eval_summary(joined: DataFrame) -> DataFrame:
    n = F.count("*")
    return joined.agg(
        n.alias("total_images"), _share(F.col("final_date_match")).alias("exact_match"),
        (ratio(_share(F.col("final_date_match")), n) * 100).alias("exact_match_pct"),
        (ratio(_share(F.col("year_match")), n) * 100).alias("year_match_pct"),
        (ratio(_share(F.col("month_match")), n) * 100).alias("month_match_pct"),
        (ratio(_share(F.col("day_match")), n) * 100).alias("day_match_pct"),
        (ratio(_share(F.col("year_match")) + _share(F.col("month_match")) + _share(F.col("day_match")), 3 * n) * 100)
        .alias("avg_component_pct"))


# --- percentiles and run metrics -----------------------------------------------------------------

def percentile_floor(df: DataFrame, value: str, q: float, *tie_break: str) -> DataFrame:
    """The element at index min(n-1, max(0, int(n*q)-1)) of the sorted values; 0.0 for no rows.

    Not interpolated. The values are indexed in a distributed sort, so no task holds them all.
    """
    indexed = with_global_index(df.filter(F.col(value).isNotNull()), value, *tie_break)
    n = indexed.agg(F.count("*").alias("n"))
    at = F.least(F.col("n") - 1, F.greatest(F.lit(0), (F.col("n") * F.lit(q)).cast("long") - 1))
    return (indexed.crossJoin(F.broadcast(n)).filter(F.col("row_index") == at)
            .agg(F.coalesce(F.max(value), F.lit(0.0)).alias("value")))


def positional(df: DataFrame, value: str, wanted: dict[str, Callable[[Column], Column]], *tie_break: str) -> DataFrame:
    """One row: for each name the value at a (possibly fractional) 0-based position, a function of the number of values.

    Between two positions the value is interpolated. The values are indexed in a distributed sort; only the ones asked
    for are gathered. Null for no rows.
    """
    indexed = with_global_index(df.filter(F.col(value).isNotNull()), value, *tie_break).select(F.col(value).cast("double").alias("__v"), "row_index")
    n = indexed.agg(F.count("*").cast("double").alias("__n"))

    def part(position: Column) -> Column:
        low = F.floor(position)
        return F.sum(F.when(F.col("row_index") == low, F.col("__v") * (low + 1 - position))
                     .when(F.col("row_index") == low + 1, F.col("__v") * (position - low)))
    return indexed.crossJoin(F.broadcast(n)).agg(*[part(at(F.col("__n"))).alias(name) for name, at in wanted.items()])


def run_metrics(predictions: DataFrame, wall_seconds: float, latency: str = "elapsed_ms") -> DataFrame:
    """Counts, NONE rate, latency mean/median/p95 and throughput of one run, as one row."""
    n = F.count("*")
    none = _share(F.col("final_date") == "NONE")
    base = predictions.agg(
        n.alias("image_count"), none.alias("none_count"), F.coalesce(ratio(none, n), F.lit(0.0)).alias("none_rate"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("latency_ms_mean"),
        F.lit(wall_seconds).alias("wall_seconds"),
        F.coalesce(ratio(F.lit(wall_seconds), n), F.lit(0.0)).alias("sec_per_image"),
        F.coalesce(ratio(n, F.lit(wall_seconds)), F.lit(0.0)).alias("images_per_sec"))
    ranks = positional(predictions, latency, {
        "latency_ms_median": lambda n: (n - 1) * 0.5,
        "latency_ms_p95": lambda n: F.greatest(F.lit(0.0), F.floor(n * 0.95) - 1)}, "image_id").fillna(0.0)
    return base.crossJoin(F.broadcast(ranks))


STAGES = ("preprocess_ms", "detection_ms", "recognition_ms", "ocr_ms", "candidate_generation_ms",
          "selection_ms", "normalization_ms")


def stage_latency(stages: DataFrame, columns: tuple[str, ...] = STAGES) -> DataFrame:
    """Mean and p95 per stage, nulls skipped. One row per stage."""
    long = (stages.unpivot(["image_id"], list(columns), "stage", "ms")
            .withColumn("ms", F.col("ms").cast("double")).filter(F.col("ms").isNotNull()))
    indexed = with_global_index(long, "stage", "ms", "image_id")
    stats = indexed.groupBy("stage").agg(F.count("*").alias("n"), F.min("row_index").alias("first"),
                                         F.avg("ms").alias("mean"))
    at = F.least(F.col("n") - 1, F.greatest(F.lit(0), (F.col("n") * F.lit(0.95)).cast("long") - 1))
    p95 = (indexed.join(F.broadcast(stats), "stage").filter(F.col("row_index") - F.col("first") == at)
           .select("stage", F.col("ms").alias("p95")))
    return stats.select("stage", "mean").join(p95, "stage")


# --- review table, recall and error categories ---------------------------------------------------

def review_table(images: DataFrame, tokens: DataFrame, scored: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per image: concatenated text, candidate set, counts, selected candidate.

    The texts of an image form one output value, so they are gathered per image by definition.
    """
    text = tokens.groupBy("image_id").agg(
        F.count("*").alias("token_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", "text"))),
                                 lambda t: t.text), " | ").alias("ocr_text"))
    shown = F.coalesce(candidate_final_date(F.col("year"), F.col("month"), F.col("day"), F.col("calendar_valid")),
                       F.col("raw_text"))
    best = F.struct(F.col("score"), (-F.col("cand_ordinal")).alias("o"), "raw_text", shown.alias("shown"))
    cands = scored.groupBy("image_id").agg(
        F.count("*").alias("candidate_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("s"), "cand_ordinal", shown.alias("shown")))), lambda c: c.shown), " | ")
        .alias("candidate_set"), F.max(best).alias("b"))
    return (images.select("image_id").join(text, "image_id", "left").join(cands, "image_id", "left")
            .join(predictions.select("image_id", "final_date", "confidence", "evidence"), "image_id", "left")
            .select("image_id", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
                    F.coalesce("token_count", F.lit(0)).alias("token_count"),
                    F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
                    F.coalesce("candidate_set", F.lit("")).alias("candidate_set"),
                    F.coalesce("b.raw_text", F.lit("NONE")).alias("candidate"),
                    F.coalesce("b.shown", F.lit("NONE")).alias("selected_candidate_normalized"),
                    F.coalesce("b.score", F.lit(0.0)).alias("candidate_score"), "final_date", "confidence",
                    F.array_join("evidence", " | ").alias("evidence")))


def evaluation_rows(predictions: DataFrame, scored: DataFrame, tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled predictions with all facts the reports need, one row per image.

    Candidates (a stored table) are compared with the label as rows; no candidate list is built. Where images span several
    tiles, the rows (image, date) are de-duplicated before they meet the label. Token facts are two map-side combined flags.
    """
    key = lambda c: F.expr(final_date_sql(c))
    lab = last_per_id(labels).select("image_id", F.col("final_date").alias("target")).withColumn("target_key", key("target"))
    shown = F.coalesce(candidate_final_date(F.col("year"), F.col("month"), F.col("day"), F.col("calendar_valid")),
                       F.col("raw_text"))
    dates = scored.select("image_id", shown.alias("shown"), F.lit(1).alias("n"))
    if not in_one_tile(scored, candidate_tile(F.col("cand_ordinal"))):
        dates = dates.groupBy("image_id", "shown").agg(F.sum("n").alias("n"))
    # the join leaves rows by image, so the facts need no further exchange
    hit = (dates.withColumn("cand_key", key("shown")).join(lab, "image_id").groupBy("image_id").agg(
        F.max(F.coalesce(F.col("cand_key") == F.col("target_key"), F.lit(False))).alias("covered"),
        F.sum("n").alias("candidate_count")))
    tok = tokens.groupBy("image_id").agg(F.count("*").alias("token_count"),
                                         F.max(is_dateish(F.col("text"))).alias("text_dateish"))
    return (predictions.join(lab, "image_id").join(hit, "image_id", "left").join(tok, "image_id", "left")
            .withColumn("predicted_key", key("final_date"))
            .withColumns({"covered": F.coalesce("covered", F.lit(False)),
                          "candidate_count": F.coalesce("candidate_count", F.lit(0)),
                          "token_count": F.coalesce("token_count", F.lit(0)),
                          "text_dateish": F.coalesce("text_dateish", F.lit(False)),
                          "is_correct": (F.col("final_date") == F.col("target"))
                          | F.col("predicted_key").eqNullSafe(F.col("target_key"))}))


def accuracy_metrics(rows: DataFrame) -> DataFrame:
    """Exact match, candidate recall, selection accuracy and per-component accuracy, one row."""
    has_target = F.col("target_key").isNotNull()
    recalled = has_target & F.col("covered")
    part = lambda p: has_target & F.col("predicted_key").isNotNull() & F.col(f"predicted_key.{p}").eqNullSafe(
        F.col(f"target_key.{p}"))
    n, den = F.count("*"), _share(has_target)
    return rows.agg(
        n.alias("labeled_count"), F.coalesce(ratio(_share(F.col("is_correct")), n), F.lit(0.0)).alias("final_date_exact_match"),
        _share(recalled).alias("candidate_recall_count"), den.alias("candidate_recall_denominator"),
        ratio(_share(recalled), den).alias("candidate_recall"),
        ratio(_share(recalled & F.col("is_correct")), _share(recalled)).alias("candidate_selection_accuracy"),
        _share(recalled).alias("candidate_selection_denominator"),
        *[ratio(_share(part(p)), den).alias(f"{p}_accuracy") for p in ("year", "month", "day")])


def error_category() -> Column:
    """Why a labelled prediction is wrong; empty when it is right. The order of the rules counts."""
    none = F.col("target_key").isNull()
    return (F.when(F.col("is_correct"), "")
            .when(~none & F.col("predicted_key").eqNullSafe(F.col("target_key")), "NORM")
            .when(none, "AMBIGUOUS / UNKNOWN")
            .when(F.col("covered"), "SEL").when(F.col("token_count") == 0, "DET")
            .when(F.col("text_dateish"), "GEN").otherwise("REC"))


def error_category_counts(rows: DataFrame) -> DataFrame:
    counts = (rows.withColumn("error_category", error_category()).filter("error_category <> ''")
              .groupBy("error_category").agg(F.count("*").alias("count")))
    total = counts.agg(F.sum("count").alias("total"))       # at most six rows in
    return counts.crossJoin(F.broadcast(total)).select(
        "error_category", "count", (F.col("count") / F.col("total")).alias("ratio"))


def recognition_metrics(rows: DataFrame, text: str = "ocr_text", truth: str = "truth_text") -> DataFrame:
    """Character error rate and exact share over rows with a truth text, one row."""
    r = rows.filter(F.coalesce(F.col(truth), F.lit("")) != "")
    n = F.count("*")
    return r.agg(
        F.when(n > 0, "available").otherwise("unavailable").alias("status"),
        ratio(F.sum(F.levenshtein(F.col(text), F.col(truth))), F.sum(F.greatest(F.lit(1), F.length(truth)))).alias("cer"),
        ratio(_share(F.col(text) == F.col(truth)), n).alias("exact_string_accuracy"), n.alias("labeled_count"))


def selection_stress(rows: DataFrame) -> DataFrame:
    """Accuracy over images with two or more candidates among which the truth is present."""
    hard = rows.filter(F.col("target_key").isNotNull() & F.col("covered") & (F.col("candidate_count") >= 2))
    right = _share(F.col("predicted_key").eqNullSafe(F.col("target_key")))
    return hard.agg(F.count("*").alias("image_count"), F.coalesce(right, F.lit(0)).alias("correct_count"),
                    ratio(right, F.count("*")).alias("selection_accuracy"))


def candidates_without_match(rows: DataFrame) -> DataFrame:
    """Labelled, readable images none of whose candidates equals the label."""
    return rows.filter(F.col("target_key").isNotNull() & ~F.col("covered")).select(
        "image_id", "target", "token_count", "candidate_count")


def labels_driving_join(pool: DataFrame, labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per label: does the pool hold it, and was it chosen. Images without candidates count as wrong.

    Plain string equality. The pool is reduced to distinct (image, prediction) before the join.
    """
    target = F.col("final_date").alias("target")
    exists = (pool.select("image_id", F.col("prediction").alias("target")).distinct()
              .withColumn("candidate_exists", F.lit(True)))
    c = chosen.select("image_id", F.col("prediction").alias("chosen"), F.col("source").alias("chosen_source"))
    return (labels.select("image_id", target).join(exists, ["image_id", "target"], "left").join(c, "image_id", "left")
            .withColumns({"candidate_exists": F.coalesce("candidate_exists", F.lit(False)),
                          "selection_exact": F.coalesce(F.col("chosen") == F.col("target"), F.lit(False))}))


def union_diagnostics(rows: DataFrame) -> DataFrame:
    n, e, s = F.count("*"), _share(F.col("candidate_exists")), _share(F.col("selection_exact"))
    one = lambda c: F.greatest(F.lit(1), c)
    return rows.agg(n.alias("images"), (e / one(n)).alias("candidate_recall"),
                    (s / one(e)).alias("selection_accuracy_given_candidate"), (s / one(n)).alias("final_em"))


def source_categories(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Which source covers the label, per image, in seven categories."""
    flag = lambda src, c: F.max(F.when(F.col("source") == src, c).otherwise(False))
    j = (pool.select("image_id", "prediction", "source").distinct()
         .join(labels.select("image_id", F.col("final_date").alias("target")), "image_id")
         .groupBy("image_id").agg(
             flag("baseline", F.lit(True)).alias("base"), flag("yolo", F.lit(True)).alias("det"),
             flag("baseline", F.col("prediction") == F.col("target")).alias("base_hit"),
             flag("yolo", F.col("prediction") == F.col("target")).alias("det_hit")))
    j = labels.select("image_id").join(j, "image_id", "left").na.fill(False)
    c = F.col
    return j.select("image_id", F.when(c("base_hit") & c("det_hit"), "both_cover")
                    .when(c("base_hit"), "baseline_only_cover").when(c("det_hit"), "detector_only_cover")
                    .when(~c("base") & ~c("det"), "no_candidate_both")
                    .when(~c("base"), "baseline_empty_detector_wrong")
                    .when(~c("det"), "detector_empty_baseline_wrong")
                    .otherwise("both_wrong_candidate").alias("source_category"))


def union_bottleneck(categories: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts per source category and ranking errors per chosen source, as (kind, name, count)."""
    errors = rows.filter(F.col("candidate_exists") & ~F.col("selection_exact"))
    return (categories.groupBy(F.lit("source_category").alias("kind"), F.col("source_category").alias("name"))
            .agg(F.count("*").alias("count"))
            .unionByName(errors.groupBy(F.lit("ranking_error").alias("kind"), F.col("chosen_source").alias("name"))
                         .agg(F.count("*").alias("count"))))


# --- merged, latency and recogniser reports ------------------------------------------------------

def merge_shards(metrics: DataFrame, wall_seconds: float) -> DataFrame:
    """Combine the metrics rows of shards: sums, maxima and denominator-weighted means."""
    weighted = lambda v, w: F.sum(F.coalesce(F.col(v), F.lit(0.0)) * F.coalesce(F.col(w), F.lit(0))) / F.nullif(
        F.sum(F.coalesce(F.col(w), F.lit(0))).cast("double"), F.lit(0.0))
    n = F.sum("image_count")
    return metrics.agg(
        n.alias("image_count"), F.lit(wall_seconds).alias("wall_seconds"),
        F.coalesce(ratio(F.lit(wall_seconds), n), F.lit(0.0)).alias("sec_per_image"),
        F.coalesce(ratio(n, F.lit(wall_seconds)), F.lit(0.0)).alias("images_per_sec"),
        weighted("final_date_exact_match", "labeled_count").alias("final_date_exact_match"),
        ratio(F.sum("candidate_recall_count"), F.sum("candidate_recall_denominator")).alias("candidate_recall"),
        weighted("candidate_selection_accuracy", "candidate_selection_denominator").alias("candidate_selection_accuracy"),
        F.coalesce(F.max("peak_ram_mb"), F.lit(0.0)).alias("peak_ram_mb"),
        F.coalesce(F.max("model_weight_mb"), F.lit(0.0)).alias("model_weight_mb"))


def latency_report(rows: DataFrame) -> DataFrame:
    """Mean, median, interpolated p95, 500-item extrapolation, fast exits and component average."""
    n = F.count("*")
    hits = _share(F.col("year_match")) + _share(F.col("month_match")) + _share(F.col("day_match"))
    ranks = positional(rows, "latency_sec", {
        "latency_sec_median": lambda n: (n - 1) * 0.5, "latency_sec_p95": lambda n: (n - 1) * 0.95})
    ranks = ranks.select(*[F.round(c, 3).alias(c) for c in ranks.columns])
    return rows.agg(
        n.alias("images"), F.round(ratio(_share(F.col("em_match")), n), 4).alias("exact_match"),
        F.round(ratio(hits, 3 * n), 4).alias("component_avg"),
        F.round(F.avg("latency_sec"), 3).alias("latency_sec_mean"),
        F.round(F.avg("latency_sec") * 500 / 60, 1).alias("extrapolated_500_min"),
        _share(F.col("fast_exit")).alias("fast_exit_count"),
        *[_share(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)]).crossJoin(F.broadcast(ranks))


def crop_eval(rows: DataFrame, seconds: float) -> DataFrame:
    """Exact share of recogniser outputs against labels, both read by ``normalize_simple``."""
    exact = normalize_simple(F.col("raw")).eqNullSafe(normalize_simple(F.col("label")))
    n = F.count("*")
    return rows.agg(n.alias("samples"), (_share(exact) / F.greatest(F.lit(1), n)).alias("exact"),
                    (F.lit(seconds) / F.greatest(F.lit(1), n)).alias("sec_per_image"))


def detector_eval(detector: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall and exact match of the detector rows over labels that can be read."""
    t = labels.select("image_id", normalize_validated(F.col("final_date")).alias("target"))
    hit = (detector.join(t, "image_id").groupBy("image_id")
           .agg(F.max(F.coalesce(F.col("prediction") == F.col("target"), F.lit(False))).alias("recall")))
    chosen = detector_choice(detector).select("image_id", F.col("prediction").alias("chosen"))
    rows = (t.join(hit, "image_id", "left").join(chosen, "image_id", "left").filter(F.col("target").isNotNull()))
    n = F.greatest(F.lit(1), F.count("*"))
    exact = _share(F.coalesce(F.col("chosen") == F.col("target"), F.lit(False)))
    return rows.agg(F.count("*").alias("valid_images"), (_share(F.coalesce("recall", F.lit(False))) / n).alias("candidate_recall"),
                    (exact / n).alias("selection_accuracy"), (exact / n).alias("final_em"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))
