"""Writers for predictions, token caches, metrics, label splits, training lists and leaderboards.

All writes are plain Spark writes: as many files as there are partitions, none gathered first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.functions.text import numeric_target
from expirylens.operators.filters import remap_classes
from expirylens.schemas import LABEL_COLUMNS


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    predictions.select(*LABEL_COLUMNS).write.mode(mode).option("header", True).csv(path)


def write_review(review: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be parquet or csv")
    review.write.mode(mode).format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).save(path)


def nested_tokens(tokens: DataFrame) -> DataFrame:
    """One row per image with its tokens in order, in the stored layout."""
    b = F.col("bbox")
    token = F.struct("token_index", "text", "confidence",
                     F.when(b.isNotNull(), F.array(b.x1, b.y1, b.x2, b.y2)).alias("bbox"),
                     (F.col("extras") if "extras" in tokens.columns else F.when(
                         F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source")))).alias("extras"),
                     "detection_confidence")
    # maps cannot be ordered, so the position leads and the map travels as pairs
    token = token.withField("extras", F.map_entries(token.getField("extras")))
    fields = lambda t: F.struct(t.text.alias("text"), t.confidence.alias("confidence"), t.bbox.alias("bbox"),
                                F.map_from_entries(t.extras).alias("extras"),
                                t.detection_confidence.alias("detection_confidence"))
    return tokens.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(token)), fields).alias("tokens"))


def write_token_cache(tokens: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one image per line: the file format itself asks for whole images."""
    nested_tokens(tokens).write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, root: str, manifest: DataFrame | None = None) -> None:
    """Metrics and manifests of runs (column run) as ``<root>/run=<run>/what=<kind>/*.json``."""
    for kind, df in (("metrics", metrics), ("run_manifest", manifest)):
        if df is not None:
            (df.withColumn("what", F.lit(kind)).write.mode("append").partitionBy("run", "what").json(root))


def write_run_table(metrics: DataFrame, manifest: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Metrics and manifests (column run) as JSON lines, one run a line, below ``<root>/metrics`` and ``<root>/run_manifest``.

    For registries of very many runs: the number of files does not grow with them. ``readers.read_run_table`` reads them back.
    """
    for kind, df in (("metrics", metrics), ("run_manifest", manifest)):
        df.write.mode(mode).json(f"{root}/{kind}")


def write_sidecar_lines(sidecars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sidecars (name, value: the JSON array of tokens) as lines ``<name> TAB <value>``; files do not grow with the sidecars.

    ``readers.read_token_sidecar_lines`` reads them back.
    """
    sidecars.select(F.concat_ws("\t", "name", "value").alias("value")).write.mode(mode).text(path)


def write_clean_flagged(audited: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Both halves of an audit in one pass: ``is_clean=true`` and ``is_clean=false`` folders."""
    (audited.select(*LABEL_COLUMNS, "num_flags", "flags", "is_clean").write.mode(mode)
     .partitionBy("is_clean").option("header", True).option("escape", '"').csv(path))


def recognizer_line(image: Column, label: Column) -> Column:
    return F.when(numeric_target(label).isNotNull(), F.concat_ws("\t", F.concat(F.lit("images/"), image), label))


def write_recognizer_list(crops: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines ``images/<image> TAB <label>`` for labels with exactly eight digits."""
    (crops.select(recognizer_line(F.col("image"), F.col("label")).alias("value"))
     .filter(F.col("value").isNotNull()).write.mode(mode).text(path))


def detector_label_lines(boxes: DataFrame, class_mode: str = "region4") -> DataFrame:
    return remap_classes(boxes, class_mode).select("image_id", "box_index", F.format_string(
        "%d %.6f %.6f %.6f %.6f", "class", "cx", "cy", "width", "height").alias("value"))


def write_detector_labels(boxes: DataFrame, path: str, class_mode: str = "region4", mode: str = "errorifexists",
                          buckets: int = 64) -> None:
    """Label lines, classes remapped, in ``buckets`` folders by a hash of the image: ``<image> TAB <line>``.

    An image's lines stand together in one file, in box order; the number of files does not grow with the images.
    ``readers.read_detector_labels`` reads them back.
    """
    lines = detector_label_lines(boxes, class_mode).withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))
    (lines.repartition(buckets, "bucket").sortWithinPartitions("bucket", "image_id", "box_index")
     .select("bucket", F.concat_ws("\t", F.coalesce("image_id", F.lit("")), "value").alias("value"))
     .write.mode(mode).partitionBy("bucket").text(path))


def write_leaderboard(rows: DataFrame, path: str, order: list[Column], fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Ranked rows; part files follow the order."""
    rows.orderBy(*order).write.mode(mode).format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
