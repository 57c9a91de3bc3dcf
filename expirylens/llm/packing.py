"""Packing by power-of-two decomposition: sequences of binary lengths, each from one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from expirylens.llm.common import arrow_rows, materialise, shared_folder
from expirylens.llm.tokens import CACHE_WORDS, Encoder


def pieces_of(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of n ids each: the document's index, the piece's length and its start there."""
    sizes = longest >> np.arange(longest.bit_length())
    counts = np.column_stack([n // longest, (n % longest)[:, None] >> np.arange(longest.bit_length() - 2, -1, -1) & 1])
    at = np.repeat(np.arange(len(n)), counts.sum(1))
    size = np.repeat(np.tile(sizes, len(n)), counts.reshape(-1))
    ends = np.cumsum(size)
    return at, size, ends - size - (np.cumsum(n) - n)[at]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         longest: int = 1024, kept_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece of each document: id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids (with ``end_id`` behind them) are cut into pieces whose lengths are powers of two, at
    most ``longest``. Every piece is a sequence of its own, so no sequence crosses documents and none needs
    padding. ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids before
    the piece; ``offset``, the place in the sequence, is 0.

    Pieces are stored in one bucket (folder) for each length; sequence numbers run through the buckets,
    from the shortest to the longest, without gaps. Texts are read once and never shuffled: numbers follow
    from the counts per bucket and input task. A worker keeps the ids of ``kept_words`` words, about 200 bytes each.

    Null and empty texts are the end id alone. Rows with equal or null ids are documents of their own, told
    apart by ``sequence_id``. A text of any length is cut; an empty table gives no rows. Columns other
    than the id and the text are left out.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "bucket", "ids", "doc_tokens", "part", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder.kept(tokenizer, kept_words), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in arrow_rows(whole):
                tokens = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                n = np.array([len(t) + 1 for t in tokens], np.int64)
                end = np.array([end_id], np.uint32)
                # pieces cut a document's ids in order, so all of them together are the documents' ids one after the other
                stream = np.concatenate([x for t in tokens for x in (t, end)], dtype="<u4", casting="unsafe")
                at, size, start = pieces_of(n, longest)
                row = np.empty(len(size), np.int64)
                for bucket in np.unique(size).tolist():
                    own = np.flatnonzero(size == bucket)
                    row[own] = seen.get(bucket, 0) + np.arange(len(own))
                    seen[bucket] = int(row[own[-1]]) + 1
                cuts = np.append(0, np.cumsum(4 * size)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array(start), pa.array(size.astype(np.int32)), ids, pa.array(n[at]),
                    pa.array(np.full(len(at), part), pa.int32()), pa.array(row)], names)

    pieces = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, start long, bucket int, ids binary, doc_tokens long, part int, row long")
    path = shared_folder(docs.sparkSession)
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.schema(pieces.schema).parquet(path)
    sizes = materialise(stored.groupBy("bucket", "part").agg(F.count("*").alias("n")))
    inside = Window.partitionBy("bucket").orderBy("part")
    below = Window.orderBy("bucket")  # one row for each length
    base = sizes.groupBy("bucket").agg(F.sum("n").alias("all")).select("bucket", (F.sum("all").over(below) - F.col("all")).alias("base"))
    first = (sizes.withColumn("before", F.sum("n").over(inside) - F.col("n")).join(base, "bucket")
             .select("bucket", "part", (F.col("before") + F.col("base")).alias("first")))
    return stored.join(first, ["bucket", "part"]).select(
        id_col, "start", F.col("bucket").cast("long").alias("length"), "ids", "doc_tokens",
        (F.col("first") + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
