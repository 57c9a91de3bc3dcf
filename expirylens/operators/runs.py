"""Run registry: classification, inventories and leaderboards of experiment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.operators.ordering import top_per_group, with_global_index


def classify_run(run_name: Column, input_dir: Column, image_count: Column, tokens_cache_used: Column,
                 ocr_plugin: Column) -> Column:
    """shard, smoke, cached-ablation, mock or fresh-ocr; only the last is eligible for ranking."""
    return (F.when(run_name.startswith("part_"), "shard")
            .when(F.coalesce(input_dir, F.lit("")).endswith("data/sample") | (F.coalesce(image_count, F.lit(0)) <= 3), "smoke")
            .when(F.coalesce(tokens_cache_used, F.lit(False)), "cached-ablation")
            .when(ocr_plugin.eqNullSafe("mock"), "mock").otherwise("fresh-ocr"))


def test_set_name(image_ids_path: Column, input_dir: Column) -> Column:
    """Stem of the ids file, else the last folder of the input."""
    base = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    has = F.coalesce(image_ids_path, F.lit("")) != ""
    source = F.when(F.coalesce(input_dir, F.lit("")) == "", "unknown").otherwise(input_dir)
    return F.when(has, F.regexp_replace(base(image_ids_path), r"(?<=.)\.[^.]*$", "")).otherwise(base(source))


def describe_architecture(ocr_plugin: Column, ocr_params: Column, preprocess: Column, selector_params: Column,
                          tokens_cache_used: Column) -> Column:
    """Readable description of a run from its configuration; parameters are string maps."""
    p, s = (lambda k: F.try_element_at(ocr_params, F.lit(k))), (lambda k: F.try_element_at(selector_params, F.lit(k)))

    def model(kind: str) -> Column:
        path = F.nullif(p(f"text_{kind}_model_dir"), F.lit(""))
        return F.coalesce(F.nullif(p(f"text_{kind}_model_name"), F.lit("")),
                          F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.lit("configured model"))
    paddle = F.concat(F.lit("Paddle split OCR: det="), model("detection"), F.lit("; rec="), model("recognition"),
                      F.when(F.coalesce(p("recognition_input_height"), F.lit("")) != "",
                             F.concat(F.lit("; rec_height="), p("recognition_input_height")))
                      .when(F.coalesce(p("input_shape"), F.lit("")).contains(","),
                            F.concat(F.lit("; rec_input_shape="), p("input_shape"))).otherwise(""))
    ocr = (F.when(F.coalesce(tokens_cache_used, F.lit(False)), "OCR token cache reuse (recognition not re-run)")
           .when(ocr_plugin == "paddle_mobile_split", paddle)
           .when(ocr_plugin == "mock", "mock OCR fixture (not a real OCR benchmark)")
           .otherwise(F.concat(F.lit("OCR="), F.coalesce(ocr_plugin, F.lit("unknown")))))
    pre = (F.when(preprocess == "none", "raw image")
           .when(preprocess == "grayscale_contrast", "grayscale + contrast preprocessing")
           .otherwise(F.concat(F.lit("preprocess="), F.coalesce(preprocess, F.lit("unknown")))))
    on = lambda k, name: F.when(s(k).isNotNull(), F.concat(F.lit(name + "="), F.when(F.lower(s(k)) == "true", "on").otherwise("off")))
    value = lambda k, name: F.when(s(k).isNotNull(), F.concat(F.lit(name + "="), s(k)))
    sanitizer = F.when(s("sanitization_mode").isNotNull() & (s("sanitization_mode") != "none"),
                       F.concat(F.lit("sanitizer="), s("sanitization_mode")))
    features = F.concat_ws(", ", on("allow_day_first", "day-first"), on("allow_month_names", "month-names"), sanitizer,
                           value("keyword_weight", "keyword"), value("position_weight", "position"))
    selector = F.concat(F.lit("regex date selector"), F.when(features != "", F.concat(F.lit(" ("), features, F.lit(")"))).otherwise(""))
    return F.concat_ws(" | ", ocr, pre, selector, F.lit("date_ko_v1 normalizer"))


INVENTORY_COLUMNS = ["experiment", "architecture", "run_kind", "rank_eligible", "run", "images", "test_set", "final_em",
                     "candidate_recall", "selection_acc", "sec_per_image", "images_per_sec", "peak_ram_mb",
                     "model_weight_mb", "detection_ms", "recognition_ms", "ocr_ms"]


def benchmark_inventory(runs: DataFrame, include_shards: bool = True) -> DataFrame:
    """One row per run. ``runs`` comes from sources.readers.read_runs.

    Speed and memory of cached runs are nulled: recognition did not run there. Order by
    (run_kind, test_set, run) when writing.
    """
    c = F.col
    kind = classify_run(c("run_name"), c("input_dir"), c("image_count"), c("tokens_cache_used"), c("ocr_plugin"))
    r = runs.withColumn("run_kind", kind)
    if not include_shards:
        r = r.filter("run_kind <> 'shard'")
    speed = lambda n: F.when(c("run_kind") != "cached-ablation", c(n)).alias(n)
    return r.select(
        F.coalesce(F.nullif(c("config_name"), F.lit("")), c("run_name")).alias("experiment"),
        describe_architecture(c("ocr_plugin"), c("ocr_params"), c("preprocess_plugin"), c("selector_params"),
                              c("tokens_cache_used")).alias("architecture"),
        "run_kind", (c("run_kind") == "fresh-ocr").alias("rank_eligible"), "run", c("image_count").alias("images"),
        test_set_name(c("image_ids_path"), c("input_dir")).alias("test_set"),
        c("final_date_exact_match").alias("final_em"), "candidate_recall",
        c("candidate_selection_accuracy").alias("selection_acc"), speed("sec_per_image"), speed("images_per_sec"),
        speed("peak_ram_mb"), "model_weight_mb", c("detection_ms_mean").alias("detection_ms"),
        c("recognition_ms_mean").alias("recognition_ms"), c("ocr_ms_mean").alias("ocr_ms"))


def _by_em() -> list[Column]:
    return [F.desc_nulls_last("final_em"), F.asc("run")]


def rank_within_split(inventory: DataFrame) -> DataFrame:
    """Rank of eligible runs inside their test set: exact match descending, nulls last, then name.

    The rank is a position in the global (test set, order) sort minus the start of the test set,
    so a test set with most of the runs is not sorted in one task.
    """
    eligible = inventory.filter("rank_eligible")
    indexed = with_global_index(eligible, F.asc("test_set"), *_by_em())
    first = indexed.groupBy("test_set").agg(F.min("row_index").alias("first"))
    return indexed.join(first, "test_set").withColumn("rank", F.col("row_index") - F.col("first") + 1).drop("row_index", "first")


def best_run_per_group(inventory: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Best eligible run per named group of test sets, and the best cached run."""
    table = F.create_map(*[F.lit(v) for name, sets in groups.items() for s in sets for v in (s, name)])
    fresh = inventory.filter("rank_eligible").withColumn("group", F.try_element_at(table, F.col("test_set")))
    cached = inventory.filter("run_kind = 'cached-ablation'").withColumn("group", F.lit("cached"))
    return top_per_group(fresh.filter("group IS NOT NULL").unionByName(cached), ["group"], _by_em()).drop("rank")


def run_kind_counts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("run_kind").agg(F.count("*").alias("count"))


# Which recorded hash belongs to which artefact.
EVIDENCE_FILES = (("metrics_sha256", "metrics.json"), ("predictions_sha256", "predictions.csv"), ("tokens_sha256", "ocr_tokens.jsonl"))


def verify_evidence(evidence: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add ``reason``: why a run is rejected, null when it is complete, eligible and unchanged.

    ``hashes`` has run, file, sha256 of the artefacts that exist.
    """
    wide = hashes.groupBy("run").agg(*[F.max(F.when(F.col("file") == f, F.col("sha256"))).alias("__" + k) for k, f in EVIDENCE_FILES])
    j = evidence.join(wide, "run", "left")
    reason = (F.when(F.col("invalid").isNotNull(), F.concat(F.lit("invalid_evidence:"), F.col("invalid")))
              .when(~F.col("status").eqNullSafe("complete"), "run_not_complete")
              .when(~F.coalesce("rank_eligible", F.lit(False)),
                    F.coalesce(F.nullif(F.col("ranking_disallowed_reason"), F.lit("")), F.lit("not_rank_eligible"))))
    for k, f in EVIDENCE_FILES:
        changed = F.col("__" + k).isNull() | ~F.col(k).eqNullSafe(F.col("__" + k))
        reason = reason.when(changed, f"artifact_hash_mismatch:{f}")
    return j.withColumn("reason", reason).drop(*["__" + k for k, _ in EVIDENCE_FILES])


def measured_leaderboard(verified: DataFrame) -> DataFrame:
    """Accepted runs with their rank, and rejected ones with their reason."""
    zero_last = F.when(F.coalesce(F.col("final_date_exact_match"), F.lit(0.0)) == 0, -1.0).otherwise(F.col("final_date_exact_match"))
    speed = F.when(F.coalesce(F.col("sec_per_image"), F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("sec_per_image"))
    accepted = with_global_index(verified.filter("reason IS NULL"), F.desc(zero_last), F.asc(speed),
                                 F.asc(F.coalesce("name", F.lit(""))), F.asc("run"))
    return (accepted.withColumn("rank", F.col("row_index") + 1).drop("row_index")
            .unionByName(verified.filter("reason IS NOT NULL").withColumn("rank", F.lit(None).cast("long"))))


def eligibility_rules(tier: Column, label_provenance: Column, tokens_cache_used: Column) -> dict[str, Column]:
    """rank_eligible, ranking_scope and the reason when a run may not be ranked."""
    ok = (tier == "val") & label_provenance.isin("human", "gemini_filtered") & ~F.coalesce(tokens_cache_used, F.lit(False))
    return {"rank_eligible": ok,
            "ranking_scope": F.when(label_provenance == "gemini_filtered", "internal_noisy_label")
            .when(label_provenance == "human", "human_labeled").otherwise("diagnostic_only"),
            "ranking_disallowed_reason": F.when(~ok, "requires fresh OCR on val with accepted label provenance")}


def failure_samples(review: DataFrame, n: int = 10) -> DataFrame:
    """First n incorrect rows with a 40-character text preview."""
    preview = F.concat(F.substring("ocr_text", 1, 40), F.when(F.length("ocr_text") > 40, "...").otherwise(""))
    return (review.filter(F.col("is_correct") == F.lit(False)).orderBy("image_id").limit(n)
            .select("image_id", "ground_truth", "final_date", "candidate", preview.alias("ocr_preview"), "evidence"))
