"""Readers for token caches, labels, boxes, detector output, runs and image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from expirylens.functions.geometry import box_from_array
from expirylens.functions.text import file_stem, trim_ws
from expirylens.operators.filters import last_per_id
from expirylens.schemas import (BOX_MANIFEST, DETECTOR_PREDICTIONS, TOKEN_CACHE, TOKEN_COLUMNS, TOKEN_JSON)

# Fixed value: file suffixes that count as images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
_IMAGE = r"(?i)\.(" + "|".join(IMAGE_SUFFIXES) + r")$"


def _token_rows(df: DataFrame) -> DataFrame:
    """Rows with image_id and tokens (array of stored tokens) to the flat token table."""
    t = F.col("t")
    return (df.select("image_id", F.posexplode("tokens").alias("token_index", "t"))
            .select("image_id", "token_index", F.coalesce(t.text, F.lit("")).alias("text"),
                    F.coalesce(t.confidence, F.lit(0.0)).alias("confidence"),
                    t.detection_confidence.alias("detection_confidence"), box_from_array(t.bbox).alias("bbox"),
                    F.try_element_at(t.extras, F.lit("source")).alias("source"), t.extras.alias("extras"))
            .select(*TOKEN_COLUMNS))


def read_token_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Token arrays stored next to the images as ``<image>.ocr.json``; the position in the array is kept.

    Images without a sidecar simply have no rows.
    """
    files = spark.read.option("pathGlobFilter", "*.ocr.json").text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.ocr\.json$", "")
    return _token_rows(files.select(file_stem(name).alias("image_id"),
                                    F.from_json("value", T.ArrayType(TOKEN_JSON)).alias("tokens")))


def read_token_sidecar_lines(spark: SparkSession, path: str) -> DataFrame:
    """Token arrays of ``writers.write_sidecar_lines``, as ``read_token_sidecars`` gives them."""
    parts = F.split("value", "\t", 2)
    return _token_rows(spark.read.text(path).select(
        file_stem(F.regexp_replace(parts[0], r"\.ocr\.json$", "")).alias("image_id"),
        F.from_json(parts[1], T.ArrayType(TOKEN_JSON)).alias("tokens")))


def read_token_cache(spark: SparkSession, paths: str | list[str], on_duplicate: str = "last",
                     drop_malformed: bool = False) -> DataFrame:
    """Token cache lines ``{"image_id", "tokens": [...]}``, one image per line; blank lines are skipped.

    An image occurring several times keeps its last line, or its first one, over the given order
    of paths; ``on_duplicate="all"`` keeps every line. Duplicates are resolved before the tokens are
    unpacked, with map-side combining.
    """
    if on_duplicate not in ("last", "first", "all"):
        raise ValueError("on_duplicate must be last, first or all")
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = None
    for i, p in enumerate(paths):
        part = spark.read.text(p).select(
            "value", F.lit(i).alias("source_number"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    lines = lines.filter(trim_ws(F.col("value")) != "")
    mode = {"mode": "PERMISSIVE" if drop_malformed else "FAILFAST"}
    rows = lines.select(F.from_json("value", TOKEN_CACHE, mode).alias("r"), "source_number", "file", "block", "line")
    rows = rows.select("r.*", "source_number", "file", "block", "line").filter(F.col("image_id").isNotNull())
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.array().cast(T.ArrayType(TOKEN_JSON))))
    if on_duplicate != "all":
        pick = F.max_by if on_duplicate == "last" else F.min_by
        rows = rows.groupBy("image_id").agg(
            pick("tokens", F.struct("source_number", "file", "block", "line")).alias("tokens"))
    return _token_rows(rows.select("image_id", "tokens"))


def read_cached_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ids of all images of token caches, those with an empty token list too: they count in totals and audits."""
    return (spark.read.text(paths).filter(trim_ws(F.col("value")) != "").select(F.from_json("value", TOKEN_CACHE).alias("r"))
            .select("r.image_id").filter("image_id IS NOT NULL").distinct())


def read_labels(spark: SparkSession, path: str, id_col: str | None = None, date_col: str | None = None,
                multi_line: bool = True) -> DataFrame:
    """CSV labels with string columns only; ``filename``/``date`` files become image_id/final_date.

    A record may hold line breaks in quotes; ``multi_line=False`` lets Spark split files without any. Of several
    records with one id the last counts (by file, then by line).
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    names = [c.strip() for c in raw.columns]
    raw = raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("line")).alias("row_order")).toDF(*names, "row_order")
    id_col = id_col or ("image_id" if "image_id" in raw.columns else "filename")
    date_col = date_col or ("final_date" if "final_date" in raw.columns else "date")
    if id_col not in raw.columns or date_col not in raw.columns:
        raise ValueError(f"Labels need an id and a date column: {path}")
    text = lambda c: trim_ws(F.coalesce(F.col(c), F.lit("")))
    key = text(id_col) if id_col == "image_id" else file_stem(text(id_col))
    rest = [c for c in raw.columns if c not in (id_col, date_col, "row_order")]
    rows = raw.select(key.alias("image_id"), text(date_col).alias("final_date"), *[text(c).alias(c) for c in rest], "row_order")
    return last_per_id(rows).drop("row_order")


def read_detector_predictions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Detector and recogniser candidates with a readable prediction, one row each.

    One object per file, or with ``multi_line=False`` one per line, which Spark can split.
    """
    rows = spark.read.schema(DETECTOR_PREDICTIONS).option("multiLine", multi_line).json(path)
    rows = rows.select(F.explode("predictions").alias("p")).select(
        F.col("p.image_id").alias("image_id"), F.col("p.target").alias("target"),
        F.posexplode_outer("p.candidates").alias("candidate_index", "c"))
    return (rows.select("image_id", "target", "candidate_index", "c.raw", "c.prediction", "c.rec_score", "c.det_conf",
                        "c.class", box_from_array(F.col("c.bbox")).alias("bbox"))
            .filter(F.col("prediction").isNotNull()))


def read_box_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Region boxes of the records that were matched (status ok), one row per box."""
    rows = spark.read.schema(BOX_MANIFEST).option("multiLine", multi_line).json(path)
    return (rows.select("dataset", F.explode("records").alias("r")).filter("r.status = 'ok'")
            .select("dataset", "r.image_id", "r.image", F.posexplode("r.boxes").alias("box_index", "b"))
            .select("dataset", "image_id", "image", "box_index", "b.*"))


def scan_images(spark: SparkSession, path: str, recursive: bool = False, exclude_hidden: bool = False) -> DataFrame:
    """Image files below a folder: image_id, path, extension, length. File contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
             .select("path", "length").filter(F.col("path").rlike(_IMAGE)))
    if exclude_hidden:
        files = files.filter(~F.col("path").rlike(r"/\._[^/]*$"))
    return files.select(file_stem(F.col("path")).alias("image_id"), "path",
                        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length")


_METRICS = T.StructType([T.StructField("image_count", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in (
    "final_date_exact_match", "candidate_recall", "candidate_selection_accuracy", "sec_per_image", "images_per_sec",
    "peak_ram_mb", "model_weight_mb", "detection_ms_mean", "recognition_ms_mean", "ocr_ms_mean")])
_PLUGIN = T.StructType([T.StructField("plugin", T.StringType()),
                        T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
_MANIFEST = T.StructType([
    T.StructField("input_dir", T.StringType()), T.StructField("image_ids_path", T.StringType()),
    T.StructField("tokens_cache_used", T.BooleanType()),
    T.StructField("config", T.StructType([T.StructField("name", T.StringType())] + [
        T.StructField(n, _PLUGIN) for n in ("ocr", "preprocess", "selector")]))])


def _folder(c):
    return F.regexp_replace(c, r"/[^/]*$", "")


def _artefact(name: str) -> str:
    """Path pattern of ``<run>/<name>.json``, or of Spark's ``<run>/what=<name>/part-...`` folders."""
    return rf"/(?:what=)?{name}(?:\.json)?(?:/[^/]*)?$"


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every metrics file below root with the run manifest beside it, one row per run folder."""
    def read(name: str, schema: T.StructType) -> DataFrame:
        path = F.col("_metadata.file_path")
        return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.json").json(root).withColumn("run", path).filter(path.rlike(_artefact(name)))
                .withColumn("run", F.regexp_replace("run", _artefact(name), "")))
    runs = _described(read("metrics", _METRICS), read("run_manifest", _MANIFEST))
    return runs.withColumn("run_name", F.element_at(F.split("run", "/"), -1))


def read_run_table(spark: SparkSession, root: str) -> DataFrame:
    """The runs of ``writers.write_run_table``, one row each, as ``read_runs`` gives them; ``run`` is the name as written."""
    def read(kind: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(T.StructType([T.StructField("run", T.StringType()), *schema])).json(f"{root}/{kind}")
    return _described(read("metrics", _METRICS), read("run_manifest", _MANIFEST)).withColumn("run_name", F.col("run"))


def _described(metrics: DataFrame, manifest: DataFrame) -> DataFrame:
    """Metrics with the settings of their manifest beside them."""
    m = manifest.select(
        "run", "input_dir", "image_ids_path", F.coalesce("tokens_cache_used", F.lit(False)).alias("tokens_cache_used"),
        F.col("config.name").alias("config_name"), F.col("config.ocr.plugin").alias("ocr_plugin"),
        F.col("config.ocr.params").alias("ocr_params"), F.col("config.preprocess.plugin").alias("preprocess_plugin"),
        F.col("config.selector.params").alias("selector_params"))
    return metrics.join(m, "run", "left")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Newline ids; blank lines and # comments are skipped, extensions removed."""
    line = F.trim("value")
    return (spark.read.text(path).filter((line != "") & ~line.startswith("#"))
            .select(F.regexp_replace(line, r"\.[^.]*$", "").alias("id")))


def read_vlm_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a vision model (multi-line texts are quoted), with ``is_success``."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    ok = (F.coalesce("confidence", F.lit("")) != "none") & (F.coalesce("reason", F.lit("")) != "API fail")
    return raw.select(file_stem(F.col("filename")).alias("image_id"), "filename", "date", "confidence", "text_found",
                      "reason", ok.alias("is_success"))


_EVIDENCE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("rank_eligible", T.BooleanType()), T.StructField("ranking_disallowed_reason", T.StringType()),
    T.StructField("ranking_scope", T.StringType()), T.StructField("label_provenance", T.StringType()),
    T.StructField("config", T.StringType()), T.StructField("image_count", T.LongType()),
    T.StructField("metrics_sha256", T.StringType()), T.StructField("predictions_sha256", T.StringType()),
    T.StructField("tokens_sha256", T.StringType()),
    T.StructField("metrics", T.StructType([T.StructField(n, T.DoubleType()) for n in (
        "final_date_exact_match", "candidate_recall", "candidate_selection_accuracy", "sec_per_image", "peak_ram_mb")])),
    T.StructField("_corrupt_record", T.StringType())])


def read_evidence(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """One evidence.json per run folder; files that cannot be parsed keep a non-null ``invalid``."""
    path = F.col("_metadata.file_path")
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
            .filter(path.rlike(_artefact("evidence")))
            .select(F.regexp_replace(path, _artefact("evidence"), "").alias("run"),
                    F.from_json("value", _EVIDENCE, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")))
    return rows.select("run", F.when(F.col("e._corrupt_record").isNotNull() | F.col("e").isNull(), "not valid JSON").alias("invalid"),
                       *[F.col(f"e.{f.name}").alias(f.name) for f in _EVIDENCE if f.name not in ("metrics", "_corrupt_record")],
                       "e.metrics.*")


def artefact_hashes(spark: SparkSession, root: str, names: tuple[str, ...] = ("metrics.json", "predictions.csv", "ocr_tokens.jsonl")) -> DataFrame:
    """sha-256 of the named files of every run folder: run, file, sha256."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "{" + ",".join(names) + "}").load(root))
    return files.select(_folder(F.col("path")).alias("run"), F.element_at(F.split("path", "/"), -1).alias("file"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


def content_checksums(spark: SparkSession, path: str) -> DataFrame:
    """CRC-32 of every image below a folder: image_id, path, crc (decimal string)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("path").rlike(_IMAGE))
    return files.select(file_stem(F.col("path")).alias("image_id"), "path", F.crc32("content").cast("string").alias("crc"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Experiment configurations, one JSON file each: name (without folder and suffix), config (VARIANT, null if it can't be parsed).

    A file with nothing but white space is an empty configuration.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    text = F.when(trim_ws(F.col("value")) == "", "{}").otherwise(F.col("value"))
    return files.select(file_stem(F.col("_metadata.file_name")).alias("name"), F.try_parse_json(text).alias("config"))


def read_detector_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines of ``writers.write_detector_labels``: image_id (empty for a null one), class, cx, cy, width, height and the line itself.

    The line follows the last tab; one that has not five parts is dropped.
    """
    line = F.substring_index("value", "\t", -1)
    parts = F.split(line, " ")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return spark.read.text(path).filter(F.contains("value", F.lit("\t")) & (F.size(parts) == 5)).select(
        F.expr("left(value, length(value) - length(substring_index(value, '\t', -1)) - 1)").alias("image_id"),
        F.get(parts, F.lit(0)).try_cast("int").alias("class"), number(1).alias("cx"), number(2).alias("cy"),
        number(3).alias("width"), number(4).alias("height"), line.alias("value"))
