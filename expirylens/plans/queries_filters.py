"""Queries over filters, samples, splits and small text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from expirylens.functions import text as T
from expirylens.operators import filters as O
from expirylens.plans import fixtures as X
from expirylens.plans.catalog import query
from expirylens.plans.oracle_parts import sql


def _docs(spark, d):
    return X.table(spark, d, "documents").withColumn("image_id", F.lpad(F.col("doc_id").cast("string"), 8, "0"))


def _doc_labels(spark, d):
    """Documents with a label: date by id, confidence by quality."""
    i = F.col("doc_id")
    month = F.lpad((i % 12 + 1).cast("string"), 2, "0")
    date = (F.when(i % 5 == 0, "NONE").when(i % 5 == 1, F.concat(F.lit("NoNE-"), month, F.lit("-03")))
            .when(i % 5 == 2, F.concat(F.lit("2024-"), month, F.lit("-None"))).otherwise(F.concat(F.lit("2024-"), month, F.lit("-15"))))
    return X.table(spark, d, "labels").select(
        F.lpad(i.cast("string"), 8, "0").alias("image_id"), date.alias("final_date"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"))


_DL = """SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS image_id, CASE doc_id % 5 WHEN 0 THEN 'NONE'
    WHEN 1 THEN 'NoNE-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-03'
    WHEN 2 THEN '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-None'
    ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS final_date,
    CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence,
    CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'year_missing' WHEN 2 THEN 'day_missing' ELSE 'full' END AS label_group FROM labels"""


@query("f1_filter_ids", sql("SELECT image_id FROM img WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)", "img"))
def f1(spark, d):
    ids = X.table(spark, d, "orders").filter("o_totalprice > 300000").select(
        F.concat(X.image_id(F.col("o_orderkey")), F.lit(".jpg")).alias("id"))
    return O.filter_ids(X.images(spark, d), ids)


@query("f2_limit_images", sql("SELECT image_id FROM img ORDER BY image_id LIMIT 100", "img"))
def f2(spark, d):
    return O.limit_images(X.images(spark, d), 100)


@query("f3_shard", sql("SELECT image_id FROM (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS i FROM img) WHERE i % 7 = 3", "img"))
def f3(spark, d):
    return O.shard(X.images(spark, d), 3, 7)


_RX = r"\d{2,4}\s*[.\-/년]\s*\d{1,2}|\d{6,8}"


@query("f4_is_dateish", f"SELECT doc_id, regexp_matches(text, '{_RX}') AS dateish FROM documents")
def f4(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.is_dateish(F.col("text")).alias("dateish"))


@query("f5_looks_date_like", r"""SELECT doc_id, length(regexp_replace(text, '[^0-9OIil|]', '', 'g')) >= 4
    OR (length(regexp_replace(text, '[^0-9OIil|]', '', 'g')) >= 2 AND regexp_matches(text, '[./:/\-]')) AS looks FROM documents""")
def f5(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.looks_date_like(F.col("text")).alias("looks"))


@query("f5_date_like_tokens", sql("SELECT image_id, token_index FROM tok WHERE token_index > 0", "tok"))
def f5_tokens(spark, d):
    return O.date_like_tokens(X.tokens(spark, d)).select("image_id", "token_index")


@query("f6_full_date_and_target", sql("""SELECT image_id, k IN (0,1,2,3,5,6,7,8,9,10,11,12,13,14,15,16) AND dated AS is_full,
    CASE WHEN dated THEN replace(replace(final_date, '-', ''), '/', '') END AS target FROM noisy""", "noisy"))
def f6(spark, d):
    f = F.col("final_date")
    return X.noisy_labels(spark, d).select("image_id", T.is_full_date(f).alias("is_full"), T.numeric_target(f).alias("target"))


@query("f7_label_group", f"WITH dl AS ({_DL}) SELECT image_id, label_group FROM dl")
def f7(spark, d):
    return _doc_labels(spark, d).select("image_id", O.label_group(F.col("final_date")).alias("label_group"))


@query("f8_evenly_spaced_sample", sql("""SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM img)
    WHERE i IN (SELECT DISTINCT CAST(round_even(g.i * ((SELECT count(*) FROM img) - 1) / 36.0::DOUBLE, 0) AS BIGINT) FROM range(37) AS g(i))""", "img"))
def f8(spark, d):
    return O.evenly_spaced_sample(X.images(spark, d), 37, "image_id")


@query("f9_hash_split", """SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS image_id,
    CASE WHEN row_number() OVER (ORDER BY sha256(lpad(CAST(doc_id AS VARCHAR), 8, '0')), doc_id) <= 100 THEN 'dev' ELSE 'lock' END AS split
    FROM documents""")
def f9(spark, d):
    return O.hash_split(_docs(spark, d).select("image_id"), 100)


@query("f10_stratified_holdout", f"""WITH RECURSIVE dl AS ({_DL}), g AS (SELECT label_group, confidence, count(*) AS n FROM dl GROUP BY ALL),
    a AS (SELECT *, CAST(round_even(n * 50.0::DOUBLE / sum(n) OVER (), 0) AS BIGINT) AS share FROM g),
    s AS (SELECT *, 50 - sum(share) OVER () AS short FROM a),
    p AS (SELECT label_group, confidence, short, row_number() OVER (ORDER BY CASE WHEN short > 0 THEN n - share - i ELSE share - i END DESC, label_group, confidence) AS r
        FROM s, range(60) AS q(i) WHERE short <> 0 AND i < CASE WHEN short > 0 THEN n - share ELSE share END),
    m AS (SELECT label_group, confidence, count(*) * max(sign(short)) AS moved FROM p WHERE r <= abs(short) GROUP BY ALL)
    SELECT label_group, confidence, n, CAST(share + coalesce(moved, 0) AS BIGINT) AS held FROM s LEFT JOIN m USING (label_group, confidence)""")
def f10(spark, d):
    out = O.stratified_holdout(_doc_labels(spark, d), 50, 20260910)
    return out.groupBy("label_group", "confidence").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("split") == "holdout", 1).otherwise(0)).alias("held"))


@query("f11_head_sample", sql("SELECT image_id, final_date FROM lab ORDER BY image_id LIMIT 25", "lab"))
def f11(spark, d):
    return O.head_sample(X.labels(spark, d), 25, "image_id")


@query("f13_filter_source", sql("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY token_index) - 1 AS token_index, text FROM tok WHERE source <> 'yolo'", "tok"))
def f13(spark, d):
    return O.filter_source(X.tokens(spark, d), "yolo").select("image_id", "token_index", "text")


@query("f14_pending_items", """SELECT image_id, (row_number() OVER (ORDER BY image_id) - 1) // 64 AS batch FROM (
    SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def f14(spark, d):
    done = _doc_labels(spark, d).filter("confidence = 'high'")
    return O.pending_items(_docs(spark, d).select("image_id"), done, 64)


@query("f15_keep_trainable_labels", f"WITH dl AS ({_DL}) SELECT image_id, final_date FROM dl WHERE label_group IN ('full', 'year_missing')")
def f15(spark, d):
    return O.keep_trainable_labels(_doc_labels(spark, d)).select("image_id", "final_date")


@query("f16_explode_label_lines", r"""SELECT image_id, md5(line) AS line, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS line_number FROM (
    SELECT min(image_id) AS image_id, line, arg_min(i, (image_id, i)) AS first FROM (SELECT image_id, trim(l, ' ') AS line, i FROM (
        SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS image_id, unnest(string_split(text, chr(10))) AS l,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE length(line) >= 3 GROUP BY line)""")
def f16(spark, d):
    return O.explode_label_lines(_docs(spark, d), "text").select("image_id", "line_number", F.md5("line").alias("line"))


@query("f17_charset", """SELECT string_agg(ch, '' ORDER BY unicode(ch)) AS charset, count(*) AS size FROM (
    SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''""")
def f17(spark, d):
    return O.charset(X.table(spark, d, "documents"), "text")


@query("f18_remap_classes", sql("""SELECT image_id, box_index, 'expiry_full' AS mode, CASE class WHEN 3 THEN 1 ELSE 0 END AS class FROM box WHERE class IN (0, 1, 3)
    UNION ALL SELECT image_id, box_index, 'expiry_binary', 0 FROM box WHERE class IN (0, 1)
    UNION ALL SELECT image_id, box_index, 'date_due_full', CASE class WHEN 3 THEN 2 ELSE class END FROM box WHERE class IN (0, 1, 3)
    UNION ALL SELECT image_id, box_index, 'region4', class FROM box""", "box"))
def f18(spark, d):
    out = None
    for mode in O.CLASS_MODES:
        part = O.remap_classes(X.boxes(spark, d), mode).select("image_id", "box_index", F.lit(mode).alias("mode"), "class")
        out = part if out is None else out.unionByName(part)
    return out


@query("a35_polygon_to_bbox", sql("""SELECT image_id, token_index, x1, y1, x2, y2, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y,
    x2 - x1 AS width, y2 - y1 AS height FROM tok""", "tok"))
def a35(spark, d):
    from expirylens.functions import geometry as G
    b = F.col("bbox")
    corners = F.array(F.array(b.x2, b.y1), F.array(b.x1, b.y1), F.array(b.x1, b.y2), F.array(b.x2, b.y2))
    t = X.tokens(spark, d).withColumn("p", G.polygon_to_bbox(corners)).withColumn("c", G.box_center_size(F.col("p")))
    return t.select("image_id", "token_index", "p.*", "c.*")


@query("a34_crop_rect", sql("""SELECT image_id, token_index, greatest(0, trunc((x1 + x2) / 2 - (x2 - x1) * 0.6)::INT - 6) AS "left",
    greatest(0, trunc((y1 + y2) / 2 - (y2 - y1) * 0.6)::INT - 6) AS top, least(400, trunc((x1 + x2) / 2 + (x2 - x1) * 0.6)::INT + 6) AS "right",
    least(150, trunc((y1 + y2) / 2 + (y2 - y1) * 0.6)::INT + 6) AS bottom FROM tok
    WHERE least(150, trunc((y1 + y2) / 2 + (y2 - y1) * 0.6)::INT + 6) > greatest(0, trunc((y1 + y2) / 2 - (y2 - y1) * 0.6)::INT - 6)""", "tok"))
def a34(spark, d):
    from expirylens.functions import geometry as G
    t = X.tokens(spark, d).withColumn("r", G.crop_rect(F.col("bbox"), F.lit(400), F.lit(150), 1.2, 6))
    return t.filter("r IS NOT NULL").select("image_id", "token_index", "r.*")
