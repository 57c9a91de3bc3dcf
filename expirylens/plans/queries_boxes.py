"""Queries over box joins, checksums, splits, weak labels and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from expirylens.operators import audit as A, boxes as B, candidates as C, routing as R
from expirylens.plans import fixtures as X
from expirylens.plans.catalog import query
from expirylens.plans.oracle_parts import sql

_W, _H = 400.0, 300.0


def pix(spark, d):
    return B.pixel_boxes(X.boxes(spark, d), _W, _H)


_BX = {"bp": """SELECT *, (cx - width / 2) * 400.0::DOUBLE AS bx1, (cy - height / 2) * 300.0::DOUBLE AS by1, (cx + width / 2) * 400.0::DOUBLE AS bx2, (cy + height / 2) * 300.0::DOUBLE AS by2 FROM box""",
       "pr": """SELECT t.image_id, t.token_index, b.class, i / greatest(1e-9, (t.x2 - t.x1) * (t.y2 - t.y1) + (bx2 - bx1) * (by2 - by1) - i) AS iou FROM (
        SELECT *, greatest(0.0, least(t.x2, bx2) - greatest(t.x1, bx1)) * greatest(0.0, least(t.y2, by2) - greatest(t.y1, by1)) AS i
        FROM tok t JOIN bp b USING (image_id)) AS z(image_id, token_index, text, conf, det, x1, y1, x2, y2, source, box_index, class, name, cx, cy, width, height, confidence, bx1, by1, bx2, by2, i), LATERAL (SELECT 1) AS o"""}
_BX["pr"] = """SELECT image_id, token_index, class, i / greatest(1e-9, (x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) - i) AS iou FROM (
    SELECT t.image_id, t.token_index, b.class, t.x1, t.y1, t.x2, t.y2, bx1, by1, bx2, by2,
        greatest(0.0, least(t.x2, bx2) - greatest(t.x1, bx1)) * greatest(0.0, least(t.y2, by2) - greatest(t.y1, by1)) AS i
    FROM tok t JOIN bp b ON t.image_id = b.image_id)"""


@query("j10_token_box_overlap", sql("""SELECT image_id, token_index, round(max(iou), 6) AS iou, round(coalesce(max(CASE WHEN class = 0 THEN iou END), 0.0), 6) AS date_iou
    FROM pr GROUP BY ALL""", "tok", "box", **_BX))
def j10(spark, d):
    return B.token_box_overlap(X.tokens(spark, d), pix(spark, d)).select(
        "image_id", "token_index", F.round("iou", 6).alias("iou"), F.round("date_iou", 6).alias("date_iou"))


@query("j10_overlap_by_class", sql("SELECT image_id, token_index, class, round(max(iou), 6) AS iou FROM pr GROUP BY ALL", "tok", "box", **_BX))
def j10_class(spark, d):
    return B.overlap_by_class(X.tokens(spark, d), pix(spark, d)).withColumn("iou", F.round("iou", 6))


@query("j11_align_boxes", sql("""SELECT i.image_id, CASE WHEN l.final_date = 'NONE' OR i.image_id NOT IN (SELECT image_id FROM tok) THEN 'missing_label_or_tokens'
    WHEN i.image_id NOT IN (SELECT c.image_id FROM cand c JOIN lab x USING (image_id) WHERE c.iso = x.final_date) THEN 'no_matching_ocr_candidate'
    WHEN i.image_id NOT IN (SELECT image_id FROM box WHERE class = 0) THEN 'no_gt_date_box' ELSE 'has_boxes' END AS outcome
    FROM img i JOIN lab l USING (image_id)""", "img", "lab", "tok", "cand", "box"))
def j11(spark, d):
    out = aligned(spark, d)
    return out.select("image_id", F.when(F.col("status").isin("ok", "trimmed_box_empty"), "has_boxes").otherwise(F.col("status")).alias("outcome"))


def aligned(spark, d):
    return X.stored(spark, d, "aligned", lambda: B.align_boxes_to_candidates(
        X.images(spark, d), X.labels(spark, d), X.tokens(spark, d), X.scored(spark, d), pix(spark, d)))


@query("j11_aligned_crops")
def j11_crops(spark, d):
    """The trimmed boxes themselves; tested against brute force on small fixtures."""
    return aligned(spark, d).filter("status = 'ok'").select("image_id", F.round("overlap", 6).alias("overlap"), "crop_box.*", "raw_text")


@query("j12_fill_missing_from_second_pass", sql("""SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY second, i) - 1 AS token_index, second FROM (
    SELECT image_id, 0 AS second, token_index AS i FROM tok WHERE source <> 'baseline'
    UNION ALL SELECT s.image_id, 1, i FROM (SELECT image_id, range AS i FROM spl, range(4)) s WHERE image_id IN (SELECT image_id FROM tok)
        AND image_id NOT IN (SELECT image_id FROM cand WHERE source <> 'baseline'))""", "tok", "cand", "spl"))
def j12(spark, d):
    out = R.fill_missing_from_second_pass(
        X.tokens(spark, d), X.split_tokens(spark, d).withColumn("source", F.lit("second")),
        lambda t: C.extract_candidates(t, True, True), "baseline")
    return out.select("image_id", "token_index", (F.col("source") == "second").cast("int").alias("second"))


# a padded box that lies wholly below the image leaves no rectangle
_RECT = """greatest(0, x1::INT - 6) AS l, greatest(0, y1::INT - 6) AS t, least(400, x2::INT + 6) AS r0, least(300, y2::INT + 6) AS b"""


@query("j13_weak_label_matches", sql(f"""SELECT image_id, label, raw_text, CASE WHEN r0 > l AND b > t THEN l END AS "left", CASE WHEN r0 > l AND b > t THEN t END AS top,
    CASE WHEN r0 > l AND b > t THEN r0 END AS "right", CASE WHEN r0 > l AND b > t THEN b END AS bottom FROM (
    SELECT image_id, label, text AS raw_text, {_RECT} FROM (SELECT s.*, l.final_date AS label, row_number() OVER (PARTITION BY s.image_id ORDER BY score DESC, rn) AS r
    FROM sc s JOIN lab l USING (image_id) WHERE s.iso = l.final_date) WHERE r = 1)""", "sc", "lab"))
def j13(spark, d):
    return B.weak_label_matches(X.scored(spark, d), X.labels(spark, d), F.lit(400), F.lit(300)).select("image_id", "label", "raw_text", "rect.*")


def _docs(spark, d):
    return X.table(spark, d, "documents")


@query("j8_match_by_checksum", """WITH a AS (SELECT sha256(text) AS crc, max('images/' || source || '/' || doc_id || '.png') AS nm FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1),
    j AS (SELECT d.doc_id, d.text, a.nm FROM documents d LEFT JOIN a ON sha256(d.text) = a.crc)
    SELECT CAST(doc_id AS VARCHAR) AS image_id, CASE WHEN nm IS NULL THEN 'no_kaggle_image_match' WHEN TRY_CAST(regexp_extract(nm, '(\\d+)\\.png$', 1) AS BIGINT) % 3 = 0 THEN 'no_label' ELSE 'ok' END AS status,
    'x/' || nm AS archive_image FROM j""".replace("\\\\", "\\"))
def j8(spark, d):
    """Documents matched to archive entries by the hash of their text."""
    docs = _docs(spark, d).withColumn("crc", F.sha2("text", 256))
    name = lambda kind, ext: F.concat(F.lit(f"x/{kind}/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(ext))
    archive = docs.filter("doc_id % 4 <> 0").select("crc", name("images", ".png").alias("name"))
    labels = docs.filter("doc_id % 3 <> 0").select(name("labels", ".txt").alias("name"))
    local = docs.select(F.col("doc_id").cast("string").alias("image_id"), "crc")
    return B.match_by_checksum(local, archive, labels).select("image_id", "status", "archive_image")


_IDS = """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS crc FROM documents WHERE doc_id % 5 <> 0),
    r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'renamed_' ELSE '' END || CAST(doc_id AS VARCHAR) AS name, sha256(text) AS crc FROM documents WHERE doc_id % 11 <> 0),
    lo AS (SELECT * FROM l WHERE name NOT IN (SELECT name FROM r)), ro AS (SELECT * FROM r WHERE name NOT IN (SELECT name FROM l))"""


@query("j9_identity_report", _IDS + """ SELECT (SELECT count(*) FROM l JOIN r USING (name)) AS same_name, (SELECT count(*) FROM l JOIN r USING (name, crc)) AS same_name_same_content,
    (SELECT count(*) FROM lo WHERE crc IN (SELECT crc FROM ro)) AS renamed_same_content, (SELECT count(*) FROM lo WHERE crc NOT IN (SELECT crc FROM ro)) AS unmatched_left,
    (SELECT count(*) FROM ro WHERE crc NOT IN (SELECT crc FROM lo)) AS unmatched_right""")
def j9(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("crc"))
    right = docs.filter("doc_id % 11 <> 0").withColumn("name", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("renamed_"), "name")).otherwise(F.col("name")))
    return B.identity_report(docs.filter("doc_id % 5 <> 0"), right)


def splits(spark, d):
    """Documents in train, val and test by a hash, every fiftieth also planted in test."""
    docs = _docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("image_id"))
    h = F.conv(F.substring(F.sha2(F.col("image_id"), 256), 1, 4), 16, 10).cast("int") % 10
    base = docs.filter("doc_id % 13 <> 0").withColumn("split", F.when(h < 7, "train").when(h < 9, "val").otherwise("test"))
    return base.unionByName(docs.filter("doc_id % 50 = 0").withColumn("split", F.lit("test"))).select("image_id", "split").distinct()


_SPLITS = {"dh": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS image_id, ('0x' || sha256(CAST(doc_id AS VARCHAR))[1:4])::INT % 10 AS h FROM documents",
           "sp": """SELECT image_id, CASE WHEN h < 7 THEN 'train' WHEN h < 9 THEN 'val' ELSE 'test' END AS split FROM dh WHERE doc_id % 13 <> 0
            UNION SELECT image_id, 'test' FROM dh WHERE doc_id % 50 = 0""",
           "ev9": "SELECT CAST(doc_id AS VARCHAR) AS image_id FROM labels UNION SELECT 'unknown_' || doc_id FROM labels WHERE toxic = 1"}


@query("j14_split_assignment", sql("""SELECT image_id, min(split) FILTER (split <> 'test') AS split FROM sp GROUP BY 1 HAVING count(*) FILTER (split = 'test') = 0""", **_SPLITS))
def j14(spark, d):
    return B.split_assignment(_docs(spark, d).select(F.col("doc_id").cast("string").alias("image_id")), splits(spark, d)).select("image_id", "split")


@query("j16_boxes_by_split", sql("SELECT image_id, split, source FROM sp JOIN (SELECT CAST(doc_id AS VARCHAR) AS image_id, source FROM documents) USING (image_id)", **_SPLITS))
def j16(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").cast("string").alias("image_id"), "source")
    return B.boxes_by_split(rows, splits(spark, d)).select("image_id", "split", "source")


@query("a30_split_leakage", sql("""SELECT measure, ids FROM (
    SELECT a.split || '_' || b.split AS measure, count(*) AS ids FROM sp a JOIN sp b ON a.image_id = b.image_id AND a.split < b.split GROUP BY 1
    UNION ALL SELECT 'union', count(DISTINCT image_id) FROM sp
    UNION ALL SELECT 'unassigned', count(*) FROM dh WHERE image_id NOT IN (SELECT image_id FROM sp)
    UNION ALL SELECT 'eval_' || split, count(*) FROM sp JOIN ev9 USING (image_id) GROUP BY split
    UNION ALL SELECT 'eval_outside', count(*) FROM ev9 WHERE image_id NOT IN (SELECT image_id FROM dh)) WHERE ids > 0""", **_SPLITS))
def a30(spark, d):
    everything = _docs(spark, d).select(F.col("doc_id").cast("string").alias("image_id"))
    lab = X.table(spark, d, "labels")
    evaluation = lab.select(F.col("doc_id").cast("string").alias("image_id")).unionByName(
        lab.filter("toxic = 1").select(F.concat(F.lit("unknown_"), F.col("doc_id").cast("string")).alias("image_id"))).distinct()
    return A.split_leakage(splits(spark, d), everything, evaluation)


@query("a32_duplicate_ids", "SELECT text_hash AS image_id, count(*) AS count FROM (SELECT md5(text) AS text_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a32(spark, d):
    return A.duplicate_ids(_docs(spark, d).select(F.md5("text").alias("image_id")))


# every reading that normalized_options gives a printed date, the chance ones of two-digit years among them (24/11/2020 reads 2024-01-01 too)
_AGREES = {"ag": """SELECT *, list_contains(CASE rn % 5 WHEN 2 THEN [y || '-' || m || '-' || dd, '20' || dd || '-0' || m[1] || '-0' || m[2], '20' || y[1:2] || '-0' || y[3] || '-0' || y[4]]
    WHEN 3 THEN [y || '-' || m || '-' || dd, m || dd || '-' || y[3:4] || '-' || y[1:2]] WHEN 4 THEN ['20' || y[1:2] || '-0' || y[3] || '-0' || y[4]]
    ELSE [y || '-' || m || '-' || dd, '20' || y[1:2] || '-' || y[3:4] || '-' || m] END, final_date) AS agrees
    FROM (SELECT d.*, l.final_date, strftime(d.d, '%Y') AS y, strftime(d.d, '%m') AS m, strftime(d.d, '%d') AS dd FROM det d JOIN lab l USING (image_id) WHERE l.final_date <> 'NONE')"""}


@query("r19_teacher_agreement", sql("""SELECT image_id, candidate_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rec_score DESC, (class = 1) DESC, candidate_index) AS r
    FROM ag WHERE agrees) WHERE r = 1""", "det", "lab", **_AGREES))
def r19(spark, d):
    return B.teacher_agreement(X.detector(spark, d), X.labels(spark, d)).select("image_id", "candidate_index")


@query("r19_teacher_agreement_rate", sql("""SELECT count(DISTINCT CASE WHEN agrees THEN image_id END) AS agreement_images, (SELECT count(*) FROM lab WHERE final_date <> 'NONE') AS eligible_images,
    round(count(DISTINCT CASE WHEN agrees THEN image_id END) / (SELECT count(*) FROM lab WHERE final_date <> 'NONE'), 6) AS agreement_rate FROM ag""", "det", "lab", **_AGREES))
def r19_rate(spark, d):
    return B.teacher_agreement_rate(B.teacher_agreement(X.detector(spark, d), X.labels(spark, d)), X.labels(spark, d), X.images(spark, d)).withColumn(
        "agreement_rate", F.round("agreement_rate", 6))


@query("a36_low_confidence_images", sql("""SELECT i.image_id FROM img i LEFT JOIN (SELECT image_id, avg(conf) AS c FROM tok GROUP BY 1) t USING (image_id)
    WHERE c IS NULL OR c < 0.6205""", "img", "tok"))
def a36(spark, d):
    return B.low_confidence_images(X.tokens(spark, d), X.images(spark, d), 0.6205).select("image_id")


@query("f15_gt_date_crops", sql("""SELECT image_id, label, round(min(bx1), 6) AS x1, round(min(by1), 6) AS y1, round(max(bx2), 6) AS x2, round(max(by2), 6) AS y2 FROM bp
    JOIN (SELECT image_id, final_date AS label FROM lab WHERE final_date <> 'NONE') USING (image_id) WHERE class = 0 GROUP BY ALL""", "box", "lab", bp=_BX["bp"]))
def f15_crops(spark, d):
    from expirylens.operators.filters import keep_trainable_labels
    out = B.gt_date_crops(pix(spark, d), keep_trainable_labels(X.labels(spark, d)))
    return out.select("image_id", "label", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


# --- routing -------------------------------------------------------------------------------------

_FAST = {"fx": """SELECT c.image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, rn) AS r FROM cand) c JOIN kw USING (image_id)
    WHERE r = 1 AND conf >= 0.85 AND kw.k IN (0, 1)"""}


@query("x1_can_fast_exit", sql("SELECT image_id FROM fx", "cand", "kw", **_FAST))
def x1(spark, d):
    return R.can_fast_exit(X.tokens(spark, d), X.candidates(spark, d))


@query("x2_has_valid_candidate", sql("SELECT image_id, image_id IN (SELECT image_id FROM cand WHERE year(d) >= 2024) AS has_valid FROM img", "img", "cand"))
def x2(spark, d):
    return R.has_valid_candidate(X.candidates(spark, d), X.images(spark, d), min_year=2024)


def _tiers(spark, d):
    t = X.tokens(spark, d)
    t2 = R.tag_source(t.filter("token_index % 2 = 0"), "baseline")
    t3 = R.tag_source(t.filter("token_index = 3"), "yolo_expert")
    return t, t2, t3, R.can_fast_exit(t, X.candidates(spark, d))


@query("x3_route_tiers", sql("""SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p, i) - 1 AS token_index, text, source FROM (SELECT image_id, 0 AS p, token_index AS i, text, source FROM tok
    UNION ALL SELECT image_id, 1, token_index, text, 'baseline' FROM tok WHERE token_index % 2 = 0 AND image_id NOT IN (SELECT image_id FROM fx)
    UNION ALL SELECT image_id, 2, token_index, text, 'yolo_expert' FROM tok WHERE token_index = 3 AND image_id NOT IN (SELECT image_id FROM fx))""", "tok", "cand", "kw", **_FAST))
def x3(spark, d):
    return R.route_tiers(*_tiers(spark, d)).select("image_id", "token_index", "text", "source")


@query("x3_tier_reached", sql("""SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM fx) THEN 1 WHEN image_id IN (SELECT image_id FROM tok WHERE token_index = 3) THEN 3 ELSE 2 END AS tier_reached
    FROM img""", "img", "tok", "cand", "kw", **_FAST))
def x3_tier(spark, d):
    _, _, t3, fast = _tiers(spark, d)
    return R.tier_reached(X.images(spark, d), t3, fast)


@query("x4_choose_pass", sql("""SELECT t.image_id, p.pass, count(*) AS tokens FROM (SELECT image_id, 'first' AS pass FROM tok WHERE token_index % 4 = 0 UNION ALL SELECT image_id, 'retry' FROM tok WHERE token_index % 4 <> 0) t
    JOIN (SELECT image_id, CASE WHEN bool_or(f AND dateish) THEN 'first' WHEN bool_or(NOT f AND dateish) THEN 'retry' WHEN bool_or(f) THEN 'first' ELSE 'retry' END AS pass FROM (
        SELECT image_id, token_index % 4 = 0 AS f, token_index > 0 AND token_index % 5 <> 4 AS dateish FROM tok) GROUP BY 1) p ON p.image_id = t.image_id AND p.pass = t.pass GROUP BY ALL""", "tok"))
def x4(spark, d):
    t = X.tokens(spark, d)
    return R.choose_pass(t.filter("token_index % 4 = 0"), t.filter("token_index % 4 <> 0")).groupBy("image_id", "pass").agg(F.count("*").alias("tokens"))


@query("x5_tag_source", sql("SELECT image_id, token_index, 'rapid' AS source FROM tok", "tok"))
def x5(spark, d):
    return R.tag_source(X.tokens(spark, d), "rapid").select("image_id", "token_index", "source")


@query("x6_replace_low_confidence", sql("""SELECT image_id, count(*) AS tokens, max(fb) AS replaced FROM (
    SELECT image_id, 0 AS fb FROM tok WHERE token_index > 0 AND image_id NOT IN (SELECT image_id FROM sw)
    UNION ALL SELECT image_id, 1 FROM spl, range(4) WHERE image_id IN (SELECT image_id FROM sw)) GROUP BY 1""", "tok", "spl", "img",
    sw="SELECT i.image_id FROM img i LEFT JOIN (SELECT image_id, sum(conf::DECIMAL(18, 6)) AS c, count(*) AS n FROM tok WHERE token_index > 0 GROUP BY 1) t USING (image_id) WHERE (c IS NULL OR c < 0.62 * n)"))
def x6(spark, d):
    first = X.tokens(spark, d).filter("token_index > 0")
    fallback = R.tag_source(X.split_tokens(spark, d), "fallback")
    out = R.replace_low_confidence(first, fallback.select(*first.columns), X.images(spark, d), 0.62)
    return out.groupBy("image_id").agg(F.count("*").alias("tokens"), F.max((F.col("source") == "fallback").cast("int")).alias("replaced"))
