"""Token ids in a file format of length-limited canonical Huffman codes.

A folder holds two tables. ``codebook`` has (id, length) of every id that occurs; canonical codes follow
from the lengths. ``blocks`` has one row for each block of whole documents, in ascending order of id by
(part, block): the documents' ids and token counts, the bit offset of every 128th token, and the codes
as big-endian bits. Any block can be decoded by itself, and any checkpoint is a place to start in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from expirylens.llm.common import arrow_rows, materialise, with_part_index
from expirylens.llm.tokens import Encoder

BLOCK_TOKENS = 1 << 18
CHECKPOINT = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``limit`` (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    steps, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        steps.append(by < len(weights))
        merged = merged[by]
        packages = merged[0:len(merged) - 1:2] + merged[1::2]
    take = 2 * (len(used) - 1)
    for own in reversed(steps):
        singles = int(own[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """symbol * 64 + length for each value of the next ``width`` bits, and that width."""
    width = max(1, int(lengths.max(initial=0)))
    table = np.ones(1 << width, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    filled = np.repeat(order * 64 + lengths[order], 1 << width - lengths[order])
    table[:len(filled)] = filled
    return table, width


def encode_block(tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes one after the other as big-endian bits (to whole 32-bit words), and the checkpoints."""
    size = lengths[tokens]
    ends = np.cumsum(size)
    if not len(tokens):
        return b"", np.zeros(0, np.int64)
    begin = ends - size
    wide = codes[tokens] << (64 - size - (begin & 31)).astype(np.uint64)
    word = begin >> 5
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((int(ends[-1]) + 31 >> 5) + 1, np.uint64)
    out[word[heads]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), heads)
    out[word[heads] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), heads)
    return out[:-1].astype(">u4").tobytes(), begin[::CHECKPOINT]


def decode_block(bits: bytes, checkpoints: np.ndarray, tokens: int, table: tuple[np.ndarray, int]) -> np.ndarray:
    """The tokens: from all checkpoints at once, one table look-up for each token."""
    entries, width = table
    # the last lane reads on behind its end, at most a checkpoint's longest codes
    words = np.append(np.frombuffer(bits, ">u4").astype(np.int64), np.zeros(CHECKPOINT * width // 32 + 3, np.int64))
    pairs = words[:-1] << 31 | words[1:] >> 1  # the 63 bits from each word on; the lowest is never needed
    at = checkpoints.astype(np.int64)
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    mask = (1 << width) - 1
    for k in range(min(CHECKPOINT, tokens)):
        entry = entries[pairs[at >> 5] >> 63 - width - (at & 31) & mask]
        out[k] = entry >> 6
        at += entry & 63
    return out.T.reshape(-1)[:tokens]


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """(id, n_tokens, wide, ids, counts): each whole text's ids with the end id behind them; ids of 2 bytes, or of 4 if wide.

    ``counts`` is set in the last row of each task: how often each id occurs in the task's rows, as 64-bit numbers by id.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.kept(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        total, held = np.zeros(0, np.int64), None

        def rows(names: pa.Array, ids: list[bytes], counts: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                names, pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width == 4] * len(ids)), pa.array(ids, pa.binary()),
                pa.array([None] * (len(ids) - 1) + [counts], pa.binary())], [id_col, "n_tokens", "wide", "ids", "counts"])

        for whole in batches:
            for batch in arrow_rows(whole):
                if held:
                    yield rows(*held, None)
                ids = [x.tobytes() + end for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
                own = np.bincount(_array(width == 4, b"".join(ids)), minlength=len(total))
                own[:len(total)] += total
                total, held = own, (batch.column(0), ids)
        if held:
            yield rows(*held, total.astype("<i8").tobytes())

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, wide boolean, ids binary, counts binary")


def _array(wide: bool, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if wide else "<u2")


def token_counts(tokens: DataFrame) -> np.ndarray:
    """Global counts by id from the counts of the tasks; at most one row for each id of the vocabulary comes to the driver."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                own = np.frombuffer(data.as_buffer(), "<i8")
                long, short = (own, total) if len(own) > len(total) else (total, own)
                total = long.copy()
                total[:len(short)] += short
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = (tokens.select("counts").filter("counts IS NOT NULL").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, limit: int = 16) -> None:
    """Write all documents to ``path`` in the file format, in ascending order of id.

    Code lengths are at most ``limit`` bits, or as many as the number of different ids needs. Documents
    are tokenized once; ids are stored, counted, and then range partitioned, with the input place as the
    second key, so a much repeated id is spread. A task encodes its range block by block.

    Null ids come first; equal ids follow each other in the order of the input. Null and empty texts are
    the end id alone. An empty table gives an empty codebook and no blocks. Columns other than the id
    and the text are left out.
    """
    spark = docs.sparkSession
    stored = _stored_tokens(docs, tokenizer, id_col, text_col, end_id)
    counts = token_counts(stored)
    lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length()))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    id_type = docs.schema[id_col].dataType.simpleString()

    def block(part: int, number: int, ids: pa.Array, tokens: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(t) for t in tokens]
        bits, checkpoints = encode_block(np.concatenate(tokens), codes, lengths)
        one = [[part], [number], [sum(sizes)], [sizes], [checkpoints], [bits]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        columns = [pa.array(x, t) for x, t in zip(one, kinds, strict=True)]
        names = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([*columns[:3], names, *columns[3:]], ["part", "block", "tokens", "doc_ids", "sizes", "checkpoints", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names, tokens, n = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            begin = 0
            for i, (wide, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                tokens.append(_array(wide, ids.as_py()))
                n += len(tokens[-1])
                if n >= BLOCK_TOKENS:
                    names.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield block(part, number, pa.concat_arrays(names), tokens)
                    begin, number, names, tokens, n = i + 1, number + 1, [], [], 0
            if begin < batch.num_rows:
                names.append(batch.column(0).slice(begin))
        if tokens:
            yield block(part, number, pa.concat_arrays(names), tokens)

    order = [F.col(id_col).asc_nulls_first(), "part", "row"]
    (stored.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "wide", "ids")
     .mapInArrow(run, f"part int, block long, tokens long, doc_ids array<{id_type}>, sizes array<long>, checkpoints array<long>, bits binary")
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))


def _stored_tokens(docs, tokenizer, id_col, text_col, end_id) -> DataFrame:
    return materialise(with_part_index(token_table(docs, tokenizer, id_col, text_col, end_id)), compression="zstd")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files; ids: little-endian unsigned 32-bit numbers,
    start: the number of ids before the document in all files."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(max((r.id for r in book), default=-1) + 1, np.int64)
    for r in book:
        lengths[r.id] = r.length
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    fields = [id_col, "part", "block", "before", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, total, names, sizes, checkpoints, bits = (batch.column(k)[i] for k in range(7))
                sizes = sizes.values.to_numpy()
                data = decode_block(bits.as_buffer(), checkpoints.values.to_numpy(), total.as_py(), table).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                names, n = names.values, len(sizes)
                for at in range(0, n, 512):
                    to = min(n, at + 512)
                    ids = [data[4 * int(ends[k] - sizes[k]):4 * int(ends[k])] for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays([
                        names.slice(at, to - at), pa.array([part.as_py()] * (to - at), pa.int32()), pa.array([number.as_py()] * (to - at), pa.int64()),
                        pa.array((ends - sizes)[at:to], pa.int64()), pa.array(sizes[at:to], pa.int64()), pa.array(ids, pa.binary())], fields)

    docs = blocks.select("part", "block", "tokens", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(
        run, f"`{id_col}` {id_type}, part int, block long, before long, n_tokens long, ids binary")
    sizes = materialise(blocks.select("part", "block", "tokens"))
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # one row for each file
    first = (sizes.withColumn("inside", F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens"))
             .join(base, "part").select("part", "block", (F.col("inside") + F.col("base")).alias("first")))
    return docs.join(first, ["part", "block"]).select(
        id_col, (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")
