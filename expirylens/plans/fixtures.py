"""Token, label, run and split tables derived from the given star-schema and text tables.

Dates printed into tokens come from ship dates moved by 9131 days, so they fall into 2020-2026.
Shared intermediate tables (tokens, candidates, features, predictions) are stored once per
session and data folder and then read back with column pruning.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from expirylens.functions.geometry import make_box
from expirylens.operators import candidates as C, normalize as N, selection as S
from expirylens.operators.ordering import in_one_tile
from expirylens.plans.storage import materialise

_stored: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Drop the memory of stored tables, so that the next use computes them again."""
    _stored.clear()


def stored(spark: SparkSession, sf_dir: str, name: str, build, store=materialise) -> DataFrame:
    """The table of that name, built and stored on first use; ``store=None`` where ``build`` stores its result itself."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = store(build()) if store else build()
    return _stored[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


SHIFT_DAYS = 9131

# The deployed parameters for the joint tests: both parser extensions on.
PARAMS = S.ScoreParams(allow_day_first=True, allow_month_names=True)
UNION = S.UnionParams(allow_day_first=True, allow_month_names=True)


def image_id(key):
    return F.concat(F.lit("img_"), F.lpad(key.cast("string"), 8, "0"))


def has_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _stored


def share_lines(spark: SparkSession, sf_dir: str) -> None:
    """Stores the numbered lines, for queries that need them more than once, as numbering sorts all line items."""
    stored(spark, sf_dir, "lines", lambda: dated_lines(spark, sf_dir).drop("image_id"))


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: image_id, rn (1-based position in the order), d (shifted date)."""
    if has_stored(spark, sf_dir, "lines"):
        return _stored[(spark.sparkContext.applicationId, sf_dir, "lines")].withColumn("image_id", image_id(F.col("l_orderkey")))
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")
    return li.select(
        "l_orderkey", image_id(F.col("l_orderkey")).alias("image_id"), F.row_number().over(w).alias("rn"),
        F.date_add(F.col("l_shipdate").cast("date"), SHIFT_DAYS).alias("d"), "l_discount", "l_tax")


def date_text(rn, d):
    return (F.when(rn % 5 == 1, F.date_format(d, "yyyy.MM.dd"))
            .when(rn % 5 == 2, F.date_format(d, "dd/MM/yyyy"))
            .when(rn % 5 == 3, F.date_format(d, "yyyyMMdd"))
            .when(rn % 5 == 4, F.upper(F.date_format(d, "ddMMMyyyy")))
            .otherwise(F.date_format(d, "yyyy년 MM월 dd일")))


def _build_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.col("rn")
    x1, y1 = 70 + 100 * ((rn - 1) % 2), 20 * rn
    dates = dated_lines(spark, sf_dir).select(
        "image_id", rn.alias("token_index"), date_text(rn, F.col("d")).alias("text"),
        F.round(0.5 + F.col("l_discount") * 4, 6).alias("confidence"),
        F.round(0.4 + F.col("l_tax") * 5, 6).alias("detection_confidence"),
        make_box(x1, y1, x1 + 80, y1 + 18).alias("bbox"),
        F.when(rn % 2 == 1, "baseline").otherwise("yolo").alias("source"))
    k = F.col("o_orderkey") % 5
    words = table(spark, sf_dir, "orders").filter(k < 4).select(
        image_id(F.col("o_orderkey")).alias("image_id"), F.lit(0).alias("token_index"),
        F.when(k == 0, "소비기한").when(k == 1, "EXP").when(k == 2, "제조일자").otherwise("LOT").alias("text"),
        F.lit(0.95).alias("confidence"), F.lit(0.9).alias("detection_confidence"),
        make_box(F.lit(0), F.lit(20), F.lit(60), F.lit(38)).alias("bbox"), F.lit("baseline").alias("source"))
    return dates.unionByName(words)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "tokens", lambda: _build_tokens(spark, sf_dir))


def _build_split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order date cut into three tokens on one row, with a word on the next row.

    Every seventh order has no boxes at all.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", image_id(F.col("o_orderkey")).alias("image_id"),
        F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS).alias("d"))
    piece = lambda i, text, x, y: F.struct(
        F.lit(i).alias("token_index"), text.alias("text"), F.lit(0.8 + i / 100).alias("confidence"),
        F.when(F.col("o_orderkey") % 7 != 0, make_box(
            F.lit(x), F.lit(y) + F.col("o_orderkey") % 3, F.lit(x + 40), F.lit(y + 18))).alias("bbox"))
    pieces = F.array(piece(0, F.lit("LOT"), 10, 60), piece(1, F.date_format("d", "MM."), 60, 11),
                     piece(2, F.date_format("d", "yyyy."), 10, 10), piece(3, F.date_format("d", "dd"), 110, 12))
    boxless = F.array(piece(0, F.date_format("d", "yyyy년"), 0, 0), piece(1, F.date_format("d", "M월"), 0, 0),
                      piece(2, F.date_format("d", "d일"), 0, 0), piece(3, F.lit("LOT"), 0, 0))
    t = F.when(F.col("o_orderkey") % 7 != 0, pieces).otherwise(boxless)
    return (o.select("image_id", F.explode(t).alias("t")).select("image_id", "t.*")
            .withColumns({"detection_confidence": F.lit(None).cast("double"),
                          "source": F.lit(None).cast("string")}))


def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "split_tokens", lambda: _build_split_tokens(spark, sf_dir))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(image_id(F.col("o_orderkey")).alias("image_id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "labels", lambda: _build_labels(spark, sf_dir))


def _build_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, final_date: the latest date of the order, NONE for status P or no line item."""
    last = dated_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("d").alias("d"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select(
        image_id(F.col("o_orderkey")).alias("image_id"),
        F.when((F.col("o_orderstatus") == "P") | F.col("d").isNull(), "NONE")
        .otherwise(F.date_format("d", "yyyy-MM-dd")).alias("final_date"))


def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labels(spark, sf_dir)
    part = lambda i: F.when(F.col("final_date") == "NONE", "NONE").otherwise(
        F.split("final_date", "-")[i])
    return f.select("image_id", part(0).alias("year"), part(1).alias("month"), part(2).alias("day"), "final_date")


def noisy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full labels with planted faults by order key modulo 17."""
    k = F.substring("image_id", 5, 8).cast("int") % 17
    f = label_parts(spark, sf_dir).withColumn("k", k).withColumn("dated", F.col("final_date") != "NONE")
    c, dated = F.col, F.col("dated")
    year = F.when(dated & (c("k") == 3), "1995").otherwise(c("year"))
    month = F.when(dated & (c("k") == 1), "13").when(dated & (c("k") == 2), "02").otherwise(c("month"))
    day = F.when(dated & (c("k") == 2), "30").when((c("k") == 6) & ~dated, "01").otherwise(c("day"))
    f = f.select("image_id", "k", "dated", year.alias("year"), month.alias("month"), day.alias("day"))
    final = (F.when(~dated, "NONE").when(c("k") == 4, F.concat_ws("/", "year", "month", "day"))
             .otherwise(F.concat_ws("-", "year", "month", "day")))
    f = f.withColumn("final_date", final)
    return f.select(F.when(c("k") == 7, "").otherwise(c("image_id")).alias("image_id"), "year", "month",
                    F.when(dated & (c("k") == 5), "00").otherwise(c("day")).alias("day"), "final_date")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "candidates", lambda: C.extract_candidates(
        tokens(spark, sf_dir), True, True, materialise=materialise, by_text=True), store=None)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_features(spark, sf_dir).drop("leads")


def _marked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        cands = candidates(spark, sf_dir)
        one_tile = in_one_tile(cands, S.candidate_tile(F.col("cand_ordinal")))
        return S.mark_leading(S.features(cands, tokens(spark, sf_dir), PARAMS), PARAMS, one_tile)
    return stored(spark, sf_dir, "features", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_candidates(features(spark, sf_dir), PARAMS)


def scored_once(spark: SparkSession, sf_dir: str, cands: DataFrame, one_tile: bool) -> DataFrame:
    """``scored`` for a query that reads it once: features that the session has not stored are built from ``cands`` and not stored."""
    if has_stored(spark, sf_dir, "features"):
        return scored(spark, sf_dir)
    return S.score_candidates(S.features(cands, tokens(spark, sf_dir), PARAMS, one_tile=one_tile), PARAMS)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each image that has one: what the predictions and the pseudo labels read of it."""
    return stored(spark, sf_dir, "selected", lambda: S.best_candidates(_marked_features(spark, sf_dir), PARAMS).select(
        "image_id", "raw_text", "year", "month", "day", "calendar_valid", "pattern", "recognition_confidence", "positive_keyword",
        "score", "evidence"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "predictions", lambda: N.normalize_prediction(
        images(spark, sf_dir).join(selected(spark, sf_dir), "image_id", "left")))


def detector_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``detector`` for a query that stored the lines: rows that the session has not stored follow from them."""
    return detector(spark, sf_dir) if has_stored(spark, sf_dir, "detector") else _build_detector(spark, sf_dir)


def detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "detector", lambda: _build_detector(spark, sf_dir))


def _build_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector/recogniser rows: one per line item; every fourth has no readable date."""
    rn = F.col("rn")
    x1, y1 = 75 + 100 * ((rn - 1) % 2), 20 * rn + 1
    return dated_lines(spark, sf_dir).select(
        "image_id", (rn - 1).alias("candidate_index"), date_text(rn, F.col("d")).alias("raw"),
        F.when(rn % 4 != 0, F.date_format(F.date_add("d", F.when(rn % 3 == 0, 1).otherwise(0)), "yyyy-MM-dd"))
        .alias("prediction"),
        F.round(0.3 + F.col("l_discount") * 6, 6).alias("rec_score"),
        F.round(0.2 + F.col("l_tax") * 9, 6).alias("det_conf"), (rn % 4).cast("int").alias("class"),
        make_box(x1, y1, x1 + 80, y1 + 18).alias("bbox"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region boxes in relative coordinates of a 400 x 300 image, one per line item."""
    rn = F.col("rn")
    return dated_lines(spark, sf_dir).select(
        "image_id", (rn - 1).alias("box_index"), (rn % 4).cast("int").alias("class"),
        F.element_at(F.array(*[F.lit(n) for n in ("date", "due", "code", "full")]), (rn % 4 + 1).cast("int")).alias("name"),
        ((112 + 100 * ((rn - 1) % 2)) / F.lit(400.0)).alias("cx"), ((20 * rn + 10) / F.lit(300.0)).alias("cy"),
        ((80 + rn) / F.lit(400.0)).alias("width"), F.lit(18 / 300.0).alias("height"),
        F.round(0.3 + F.col("l_tax") * 8, 6).alias("confidence"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, event type): a measured run with counts taken from its events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(
        F.count("*").alias("images"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.max("value"), 6).alias("max_value"),
        F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("hits"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config_id, config, key, value: a nested configuration for each part, in six shapes, and one of five dotted overrides."""
    size = F.col("p_size").cast("string")
    pick = lambda n, *values: F.element_at(F.array(*values), (F.col("p_partkey") % n + 1).cast("int"))
    text = pick(6, F.concat(F.lit('{"selector": {"plugin": "keyword_regex", "params": {"keyword_weight": '), size, F.lit('}}, "ocr": "mock"}')),
                F.lit('{"selector": "union_spatial"}'), F.lit("{}"), F.lit('{"selector": {"params": {"position_weight": 0.25}}, "normalizer": null}'),
                F.lit('{"selector": {"plugin": "keyword_regex", "params": null}}'), F.lit('{"selector": {"plugin": 7, "params": {}}, "a": {"b": {"c": 1}}}'))
    key = pick(5, *[F.lit(k) for k in ("selector.params.keyword_weight", "a.b.c", "ocr", "selector.plugin", "x.y.z.w")])
    value = pick(5, F.concat(size, F.lit("5")), size, F.lit('"other"'), F.lit('"union_spatial"'), F.lit("true"))
    # parts may be one row group, that is one task, and each row takes long: spread over the cores first
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(F.col("p_partkey").alias("config_id"), F.parse_json(text).alias("config"),
                                               key.alias("key"), F.parse_json(value).alias("value"))
