"""One query for each operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from expirylens.llm.common import table, text_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.sharding import shard

    text = text_column()
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(rows, "doc_id", 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), "grown_shard")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=64, max_diff=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.packing import pack
    from expirylens.llm.tokens import default_path

    pieces = pack(table(spark, sf_dir, "documents"), default_path(), end_id=0, longest=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.common import shared_folder
    from expirylens.llm.huffman import read_tokens, write_tokens
    from expirylens.llm.tokens import default_path

    path = shared_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, default_path(), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.pii import pseudonymise

    found = pseudonymise(table(spark, sf_dir, "documents"), key="production")
    return found.select("doc_id", "text", F.size("pii_spans").alias("n_found"), F.col("pii_spans.kind").alias("kinds"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.html_extraction import extract

    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four kinds of evidence, documents by their text and their source as host."""
    from expirylens.llm.language import fit_text_model, identify, page_rows

    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    keep = ["kind", "doc_id", "page_id", "url"]
    pages = table(spark, sf_dir, "pages").withColumns({"kind": F.lit("page"), "doc_id": F.lit(None).cast("long")})
    rows = page_rows(pages, keep).unionByName(docs.select(
        F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), none.alias("url"), "text", none.alias("declared"),
        F.col("source").alias("host"), none.alias("domain"), none.alias("suffix")))
    return identify(rows, fit_text_model(docs), keep)


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.spelling import group_variants, word_counts

    return group_variants(word_counts(table(spark, sf_dir, "documents"), least_length=6, least_count=5, damage=199))


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.secrets import scan

    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from expirylens.llm.ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLES["op13_search"] = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN lengths USING (doc_id) JOIN weights USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
