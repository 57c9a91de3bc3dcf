"""Date candidates from token tables.

The token pass is a pure projection: every date-like span of a token is found, checked and
de-duplicated inside the token's own row, so it needs no shuffle and an image of any size
spreads over all tasks. The joined-line pass touches only images where that found nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.functions.dates import FLAG_PAIRS, annotated_spans, explode_spans, trim_sql, trimmed_sql
from expirylens.functions.geometry import box_from_array, union_boxes
from expirylens.functions.text import sanitize_tokens
from expirylens.operators.lines import reconstruct_lines
from expirylens.schemas import ORDINAL_STRIDE, as_tokens

CANDIDATE_COLUMNS = [
    "image_id", "cand_ordinal", "raw_text", "year", "month", "day", "calendar_valid", "pattern",
    "token_indices", "first_index", "recognition_confidence", "detection_confidence",
    "first_box", "union_box", "sources", "joined"]

def detection_confidence(column: Column, extras: Column) -> Column:
    """The column when set, else the value kept among the extras, else 0."""
    return F.coalesce(column, F.try_element_at(extras, F.lit("detection_confidence")).try_cast("double"),
                      F.lit(0.0))


# Every shape of the grammar needs a digit, or a letter that can be misread for one.
_MAY_HOLD_DATE = "[0-9OoIil|]"


def text_spans(texts: DataFrame, day_first: bool = False, month_names: bool = False, keep_invalid: bool = False) -> DataFrame:
    """(text, spans) for each different trimmed text of the column ``text`` that holds a candidate; the grammar runs once for each."""
    known = texts.filter(F.col("text").rlike(_MAY_HOLD_DATE)).select(F.expr(trimmed_sql("text")).alias("__trimmed")).distinct()
    return explode_spans(known, "__trimmed", ["__trimmed"], day_first, month_names, keep_invalid=keep_invalid, as_array=True)


def token_candidates(tokens: DataFrame, day_first: bool = False, month_names: bool = False,
                     keep_invalid: bool = False, by_text: bool = False, materialise=None) -> DataFrame:
    """Candidates found inside single tokens.

    With ``by_text`` the grammar runs over the dictionary of different texts, and tokens get their spans by a join on the text:
    for tables whose texts repeat, as printed words do. Then only texts with a candidate are kept, and a text with very many
    tokens is split by the skew join of adaptive execution. With ``materialise`` the dictionary is stored first, so that its size is
    known and tokens are not shuffled where it can be broadcast.
    """
    t = as_tokens(tokens).filter(F.col("text").rlike(_MAY_HOLD_DATE)).withColumn(
        "detection", detection_confidence(F.col("detection_confidence"), F.col("extras")))
    keep = ["image_id", "token_index", "confidence", "detection", "bbox", "source"]
    if by_text:
        spans = text_spans(t, day_first, month_names, keep_invalid)
        spans = materialise(spans) if materialise else spans
        found = (t.select(*keep, F.expr(trimmed_sql("text")).alias("__trimmed")).join(spans, "__trimmed")
                 .select(*keep, F.posexplode("spans").alias("pos", "s")))
    else:
        found = explode_spans(t, trim_sql("text"), keep, day_first, month_names, keep_invalid=keep_invalid)
    return found.select(
        "image_id", (F.col("token_index").cast("long") * ORDINAL_STRIDE + F.col("pos")).alias("cand_ordinal"),
        F.col("s.raw_text").alias("raw_text"), F.col("s.year").alias("year"),
        F.col("s.month").alias("month"), F.col("s.day").alias("day"),
        F.col("s.valid").alias("calendar_valid"), F.col("s.pattern").alias("pattern"),
        F.array("token_index").alias("token_indices"), F.col("token_index").alias("first_index"),
        F.col("confidence").alias("recognition_confidence"),
        F.col("detection").alias("detection_confidence"), F.col("bbox").alias("first_box"),
        F.col("bbox").alias("union_box"), F.array("source").alias("sources"),
        F.lit(False).alias("joined"))


def images_without_candidates(tokens: DataFrame, cands: DataFrame) -> DataFrame:
    """Ids of images that have tokens but no candidate.

    One aggregate with map-side combining instead of an anti-join: an image of any size leaves
    at most one row per task.
    """
    return (tokens.select("image_id", F.lit(0).alias("hit"))
            .unionByName(cands.select("image_id", F.lit(1).alias("hit")))
            .groupBy("image_id").agg(F.max("hit").alias("hit"))
            .filter("hit = 0").select("image_id"))


def joined_candidates(tokens: DataFrame, found: DataFrame, day_first: bool = False,
                      month_names: bool = False, keep_invalid: bool = False,
                      y_tolerance: float = 0.6, materialise=None) -> DataFrame:
    """Candidates from reconstructed lines, for images without any candidate in ``found``.

    Each line is tried as it is and without blanks; an image keeps only the first such text that
    yields anything.
    """
    t = as_tokens(tokens)
    bare = images_without_candidates(t, found)
    bare = materialise(bare) if materialise else bare
    own = t.join(bare, "image_id", "left_semi")
    lines = reconstruct_lines(materialise(own) if materialise else own, y_tolerance)
    lines = lines.filter(F.col("text").rlike(_MAY_HOLD_DATE))
    variants = lines.select(
        "image_id", "line_ordinal", "members", "token_indices",
        F.posexplode(F.array(F.col("text"), F.replace(F.col("text"), F.lit(" "), F.lit(""))))
        .alias("__v", "variant"))
    variants = variants.withColumn("variant_ordinal", F.col("line_ordinal") * 2 + F.col("__v"))
    keep = ["image_id", "variant_ordinal", "members", "token_indices"]
    hits = explode_spans(variants, "variant", keep, day_first, month_names, joined=True,
                         keep_invalid=keep_invalid, as_array=True)
    # min_by keeps one text per image and combines on the map side
    body = F.struct("members", "token_indices", "spans")
    first = (hits.groupBy("image_id").agg(F.min_by(body, "variant_ordinal").alias("v"))
             .select("image_id", "v.*"))
    n = F.size("members")

    def mean(field: str) -> Column:
        return F.aggregate("members", F.lit(0.0), lambda a, m: a + m[field]) / n
    return first.select(
        "image_id", mean("confidence").alias("recognition_confidence"),
        mean("detection_confidence").alias("detection_confidence"), "token_indices",
        F.get("token_indices", F.lit(0)).alias("first_index"),
        F.get("members", F.lit(0)).bbox.alias("first_box"),
        union_boxes(F.transform("members", lambda m: m.bbox)).alias("union_box"),
        F.transform("members", lambda m: m.source).alias("sources"), "spans").select(
        "*", F.posexplode("spans").alias("pos", "s")).select(
        "image_id",
        # one text per image survives, so the position inside it orders its candidates
        F.col("pos").cast("long").alias("cand_ordinal"),
        F.col("s.raw_text").alias("raw_text"), F.col("s.year").alias("year"),
        F.col("s.month").alias("month"), F.col("s.day").alias("day"),
        F.col("s.valid").alias("calendar_valid"), F.col("s.pattern").alias("pattern"),
        "token_indices", "first_index", "recognition_confidence", "detection_confidence",
        "first_box", "union_box", "sources", F.lit(True).alias("joined"))


def extract_candidates(tokens: DataFrame, day_first: bool = False, month_names: bool = False,
                       keep_invalid: bool = False, sanitization_mode: str = "none",
                       join_lines: bool = True, materialise=None, by_text: bool = False) -> DataFrame:
    """All date candidates of a token table (token pass, then the joined-line pass).

    ``by_text`` runs the token pass over the dictionary of different texts (see ``token_candidates``).

    The joined-line pass asks which images the token pass left empty, so the token pass is
    evaluated twice unless ``materialise`` (see plans.storage) stores its result first. Then the tokens and
    the candidates of the second pass are stored as well, and the result reads stored tables only.
    """
    t = as_tokens(tokens)
    if sanitization_mode != "none":
        t = as_tokens(sanitize_tokens(t, sanitization_mode))
    found = token_candidates(t, day_first, month_names, keep_invalid, by_text, materialise).select(*CANDIDATE_COLUMNS)
    if not join_lines:
        return found
    if materialise:
        found = materialise(found)
    joined = joined_candidates(t, found, day_first, month_names, keep_invalid, materialise=materialise).select(*CANDIDATE_COLUMNS)
    return found.unionByName(materialise(joined) if materialise else joined)


def annotated_candidates(tokens: DataFrame, keep_invalid: bool = False, join_lines: bool = True, y_tolerance: float = 0.6,
                         materialise=None) -> DataFrame:
    """The candidates under all four settings of the parser flags, from one run of the grammar over texts and one over lines.

    Columns are those of candidates, but ``cand_base`` in place of the ordinal, with ``flags`` (mask of the settings, see
    ``dates.FLAG_PAIRS``) and ``places`` (position under each setting). ``candidates_under`` takes the rows of one setting.
    The line pass covers each image for the settings under which its tokens gave nothing: lines are built once for all of them,
    and a line candidate has a row for each setting whose first fitting text holds it. An image without tokens has no row.

    ``materialise`` stores the dictionary of texts, which images the line pass covers, and its candidates. Those of the tokens are not
    stored: a look-up in the dictionary costs less than to write and read them.
    """
    t = as_tokens(tokens)
    dated = t.filter(F.col("text").rlike(_MAY_HOLD_DATE)).withColumn(
        "detection", detection_confidence(F.col("detection_confidence"), F.col("extras")))
    keep = ["image_id", "token_index", "confidence", "detection", "bbox", "source"]
    known = dated.select(F.expr(trimmed_sql("text")).alias("__trimmed")).distinct()
    spans = annotated_spans(known, "__trimmed", ["__trimmed"], keep_invalid=keep_invalid)
    spans = materialise(spans) if materialise else spans
    found = (dated.select(*keep, F.expr(trimmed_sql("text")).alias("__trimmed")).join(spans, "__trimmed")
             .select(*keep, F.explode("spans").alias("s")).select(
        "image_id", (F.col("token_index").cast("long") * ORDINAL_STRIDE).alias("cand_base"), *_span_fields(),
        F.array("token_index").alias("token_indices"), F.col("token_index").alias("first_index"),
        F.col("confidence").alias("recognition_confidence"), F.col("detection").alias("detection_confidence"),
        F.col("bbox").alias("first_box"), F.col("bbox").alias("union_box"), F.array("source").alias("sources"),
        F.lit(False).alias("joined"), "s.flags", "s.places"))
    if not join_lines:
        return found
    keep_table = materialise or (lambda df: df)
    every = (1 << len(FLAG_PAIRS)) - 1
    masks = spans.select("__trimmed", F.expr("aggregate(spans, 0, (a, s) -> a | s.flags)").alias("flags"))
    trimmed = F.when(F.col("text").rlike(_MAY_HOLD_DATE), F.expr(trimmed_sql("text")))
    bare = keep_table(t.select("image_id", trimmed.alias("__trimmed")).join(masks, "__trimmed", "left")
                      .groupBy("image_id").agg((F.coalesce(F.bit_or("flags"), F.lit(0)).bitwiseXOR(F.lit(every))).alias("bare"))
                      .filter("bare <> 0"))
    lines = reconstruct_lines(keep_table(t.join(bare, "image_id", "left_semi")), y_tolerance)
    variants = (lines.filter(F.col("text").rlike(_MAY_HOLD_DATE)).select(
        "image_id", "line_ordinal", "members", "token_indices",
        F.posexplode(F.array(F.col("text"), F.replace(F.col("text"), F.lit(" "), F.lit("")))).alias("__v", "variant"))
        .withColumn("variant_ordinal", F.col("line_ordinal") * 2 + F.col("__v")))
    hits = annotated_spans(variants, "variant", ["image_id", "variant_ordinal", "members", "token_indices"], True, keep_invalid)
    # one row for each setting under which the image is bare and this text yields something, then the first text of each
    bit = F.expr("shiftleft(1, setting)")
    body = F.struct("members", "token_indices", "spans")
    first = (hits.join(bare, "image_id").withColumn("setting", F.explode(F.array(*[F.lit(j) for j in range(len(FLAG_PAIRS))])))
             .filter((F.col("bare").bitwiseAND(bit) != 0) & F.exists("spans", lambda s: s.flags.bitwiseAND(bit) != 0))
             .groupBy("image_id", "setting").agg(F.min_by(body, "variant_ordinal").alias("v"))
             .select("image_id", "setting", "v.*"))
    n = F.size("members")

    def mean(field: str) -> Column:
        return F.aggregate("members", F.lit(0.0), lambda a, m: a + m[field]) / n
    joined = first.select("*", F.explode("spans").alias("s")).filter(F.col("s.flags").bitwiseAND(bit) != 0).select(
        "image_id", F.lit(0).cast("long").alias("cand_base"), *_span_fields(), "token_indices",
        F.get("token_indices", F.lit(0)).alias("first_index"), mean("confidence").alias("recognition_confidence"),
        mean("detection_confidence").alias("detection_confidence"), F.get("members", F.lit(0)).bbox.alias("first_box"),
        union_boxes(F.transform("members", lambda m: m.bbox)).alias("union_box"),
        F.transform("members", lambda m: m.source).alias("sources"), F.lit(True).alias("joined"), bit.alias("flags"), "s.places")
    return found.unionByName(keep_table(joined))


def _span_fields() -> list[Column]:
    return [F.col("s.raw_text"), F.col("s.year"), F.col("s.month"), F.col("s.day"), F.col("s.valid").alias("calendar_valid"),
            F.col("s.pattern")]


def candidates_under(annotated: DataFrame, day_first: bool, month_names: bool) -> DataFrame:
    """The candidates of one setting of the parser flags, as ``extract_candidates`` gives them."""
    j = FLAG_PAIRS.index((bool(day_first), bool(month_names)))
    ordinal = F.col("cand_base") + F.get("places", F.lit(j)) - 1
    return annotated.filter(F.col("flags").bitwiseAND(F.lit(1 << j)) != 0).withColumn("cand_ordinal", ordinal).select(*CANDIDATE_COLUMNS)


def candidates_with_places(annotated: DataFrame, pairs: list[tuple[bool, bool]]) -> tuple[DataFrame, dict[str, str]]:
    """The candidates under any of the settings, each row once, and for each setting a suffix and the column of the ordinals under it.

    The ordinal is null where the setting does not have the candidate. ``cand_ordinal`` is that of the token, for its tile only.
    """
    places = {f"_{FLAG_PAIRS.index((bool(d), bool(m)))}": f"place_{FLAG_PAIRS.index((bool(d), bool(m)))}" for d, m in pairs}
    indexes = [int(s[1:]) for s in places]
    some = F.col("flags").bitwiseAND(F.lit(sum(1 << j for j in indexes))) != 0
    own = [F.when(F.col("flags").bitwiseAND(F.lit(1 << j)) != 0, F.col("cand_base") + F.get("places", F.lit(j)) - 1).alias(f"place_{j}")
           for j in indexes]
    return annotated.filter(some).withColumn("cand_ordinal", F.col("cand_base")).select(*CANDIDATE_COLUMNS, *own), places


def dedup_candidates(cands: DataFrame) -> DataFrame:
    """First candidate per (components, pattern, token indices) of an image, by generation order.

    ``extract_candidates`` already does this inside each row; this is the stand-alone form for
    candidate tables from elsewhere. min_by combines on the map side.
    """
    keys = ["image_id", "year", "month", "day", "pattern", "token_indices"]
    rest = [c for c in cands.columns if c not in keys]
    return (cands.groupBy(*keys).agg(F.min_by(F.struct(*rest), "cand_ordinal").alias("r"))
            .select(*keys, "r.*").select(*cands.columns))


def candidates_from_detector(detector: DataFrame) -> DataFrame:
    """Detector/recogniser rows as selection candidates with source ``yolo``."""
    out = detector.select(
        "image_id", "candidate_index", F.col("prediction"), F.lit("yolo").alias("source"),
        F.log(F.greatest(F.coalesce(F.col("rec_score"), F.lit(0.0)), F.lit(1e-6))).alias("score"),
        F.coalesce(F.col("rec_score"), F.lit(0.0)).alias("rec"),
        F.coalesce(F.col("det_conf"), F.lit(0.0)).alias("det"),
        F.coalesce(F.col("class"), F.lit(0)).alias("class"),
        (box_from_array(F.col("bbox")) if detector.schema["bbox"].dataType.typeName() == "array"
         else F.col("bbox")).alias("bbox"))
    return out.filter(F.col("prediction").isNotNull() & (F.col("prediction") != ""))
