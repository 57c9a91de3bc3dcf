"""From a selected candidate to a prediction in the strict output vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from expirylens.functions.dates import candidate_key, parse_date_text


def normalize_prediction(selected: DataFrame, none_token: str = "NONE", year_missing_token: str | None = None,
                         day_missing_token: str | None = None) -> DataFrame:
    """One prediction per selected row; rows without a candidate (null pattern) become all NONE.

    An invalid candidate is read once more from its raw text; if that fails too, the prediction is
    all NONE with evidence ``normalization_failed``.
    """
    none, c = F.lit(none_token), F.col
    year_missing, day_missing = F.lit(year_missing_token or none_token), F.lit(day_missing_token or none_token)
    key = candidate_key(c("year"), c("month"), c("day"), c("calendar_valid"))
    again = F.when(~c("calendar_valid"), parse_date_text("raw_text", "pattern", pattern_column=True))
    out = selected.withColumns({"__key": key, "__again": again})
    again_key = candidate_key(c("__again.year"), c("__again.month"), c("__again.day"), c("__again.calendar_valid"))
    out = out.withColumn("__k", F.coalesce(c("__key"), again_key))
    found = c("__k").isNotNull()
    failed = c("pattern").isNotNull() & ~found
    empty = F.array().cast("array<string>")
    out = out.select(
        "image_id",
        F.when(found, F.coalesce(c("__k.year"), year_missing)).otherwise(none).alias("year"),
        F.when(found, c("__k.month")).otherwise(none).alias("month"),
        F.when(found, F.coalesce(c("__k.day"), day_missing)).otherwise(none).alias("day"),
        F.coalesce(c("score"), F.lit(0.0)).alias("confidence"),
        F.when(failed, F.array_append(c("evidence"), F.lit("normalization_failed")))
        .otherwise(F.coalesce(c("evidence"), empty)).alias("evidence"))
    all_none = (c("year") == none) & (c("month") == none) & (c("day") == none)
    final = F.when(all_none, none).otherwise(F.concat_ws("-", "year", "month", "day"))
    return out.select("image_id", "year", "month", "day", final.alias("final_date"), "confidence", "evidence")


NORMALIZERS = {"date_ko_v1": normalize_prediction}


def normalizer(name: str):
    if name not in NORMALIZERS:
        raise ValueError(f"Unknown normalizer '{name}'. Available: {sorted(NORMALIZERS)}")
    return NORMALIZERS[name]
