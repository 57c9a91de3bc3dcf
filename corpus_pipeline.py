"""A corpus pipeline of five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from expirylens.llm import decontamination, packing, pii, simhash, tokens, toxicity
from expirylens.llm.common import materialise, table

# Exact Jaccard similarity of word shingles from which documents are near copies, and the fingerprints that propose them.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
BITS, ROUTES = 512, 20


def stored(docs: DataFrame) -> DataFrame:
    """A table of whole documents, written and read again. Seven such copies are most of what a run keeps on disk, so they are packed tighter than by default."""
    return materialise(docs, "zstd")


# Names the row that a stage decides on; ids may be null or repeat.
ROW = "__row"


def with_row_key(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row (its task and its place there), stored, so that it stays the same."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows whose keys are not among the bad ones, without the key."""
    return docs.join(materialise(bad.select(ROW)), ROW, "left_anti").select([c for c in docs.columns if c != ROW])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated score is below one half."""
    docs = with_row_key(docs)
    found = toxicity.score(docs, table(spark, sf_dir, "labels"), row_col=ROW)
    return without(docs, found.filter("predicted = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least id, null ids last."""
    docs = with_row_key(docs)
    # equal ids are ordered by a hash of the text, so that the choice does not hang on how rows are stored
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.col(ROW).alias("row"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", shingle=SHINGLE_WORDS, bits=BITS,
                                    max_diff=simhash.proposing_bits(SIMILARITY, BITS), routes=ROUTES, least=SIMILARITY)
    return without(docs, found.filter("key.row <> component_id.row").select(F.col("key.row").alias(ROW)))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item within its edit budget."""
    docs = with_row_key(docs)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), id_col=ROW).drop(ROW)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows the new text."""
    found = pii.pseudonymise(docs, key="production").drop("pii_spans")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: one row for each piece, its ids as little-endian unsigned 32-bit numbers."""
    return packing.pack(docs, tokens.default_path(), end_id=0, longest=1024, kept_words=500_000)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each), ("decontamination", drop_benchmark),
          ("pii", replace_personal), ("packing", pack_sequences)]

# The stages tokenize, learn and measure edit distances, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
