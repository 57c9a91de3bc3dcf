"""Ranked lexical search over impact lists by the Best Position Algorithm.

One pass over the documents keeps, for the terms that the items ask for, each document's counts. Global counts give the weights. Then
every task turns bounded shards of documents into impact lists (documents by falling impact, one list for each term) and
answers every item from them: lists are read in parallel, a document met for the first time is looked up directly in all other
lists, and the places so touched are marked. A list's *best position* is the end of its unbroken run of marked places; the sum
of the impacts there bounds every document not met yet. Reading stops when that bound lies strictly below the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from expirylens.llm.common import arrow_rows, materialise

# Postings of a shard of documents, characters of items on the driver at a time, and entries read from a list at first and at most.
SHARD_POSTINGS, BLOCK_CHARS, FIRST_READ, MOST_READ = 3_000_000, 4_000_000, 64, 4096

# A term is a run of ASCII letters and digits and of anything from U+0080 on; only A-Z is lower-cased. In UTF-8, bytes do.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def words_of(text: str | None) -> list[bytes]:
    return [t for t in terms(text) if t]


def weight(n: int, df: int) -> int:
    """A term's weight, of n documents with terms and df that hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """How much a term's frequency counts in documents of n terms, in whole numbers."""
    m = 50 + 50 * n * docs // max(1, length)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Lists:
    """Impact lists of one shard: documents by falling impact, and for direct access the same by document with the places there."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        by_doc = np.lexsort((doc, term))
        self.doc, term, self.impact = doc[by_doc], term[by_doc], impact[by_doc]
        order = np.lexsort((self.doc, -self.impact, term))
        self.sorted_doc, self.sorted_impact = self.doc[order], self.impact[order]
        self.known, starts = np.unique(term, return_index=True)
        self.bounds = np.append(starts, len(term))
        # the place of each entry inside its own list
        self.place = np.empty(len(term), np.int64)
        self.place[order] = np.arange(len(term))
        self.place -= np.repeat(starts, np.diff(self.bounds))

    def of(self, term: int) -> slice:
        k = np.searchsorted(self.known, term)
        return slice(int(self.bounds[k]), int(self.bounds[k + 1])) if k < len(self.known) and self.known[k] == term else slice(0, 0)


def best_positions(lists: Lists, item: list[tuple[int, int]], k: int, kth: int, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a shard and their scores: all that can be among the best k, given that scores below ``kth`` can't; and the entries read.

    ``item`` holds terms with their weights. ``met`` (one flag for each document) must be clear, and is cleared again.
    """
    own = [(lists.of(t), w) for t, w in item if w > 0]
    own = [(s, w) for s, w in own if s.stop > s.start]
    seen = [np.zeros(s.stop - s.start, bool) for s, _ in own]
    best, read, step = [0] * len(own), [0] * len(own), FIRST_READ
    docs, scores, top = [], [], np.zeros(0, np.int64)
    while own:
        fresh = [lists.sorted_doc[s.start + r:min(s.stop, s.start + r + step)] for (s, _), r in zip(own, read, strict=True)]
        read = [r + len(f) for r, f in zip(read, fresh, strict=True)]
        new = np.unique(np.concatenate(fresh))
        new = new[~met[new]]
        if len(new):
            met[new] = True
            score = np.zeros(len(new), np.int64)
            for (s, w), marks in zip(own, seen, strict=True):
                at = np.searchsorted(lists.doc[s], new)
                hit = np.flatnonzero(at < s.stop - s.start)
                hit = hit[lists.doc[s.start + at[hit]] == new[hit]]
                score[hit] += w * lists.impact[s.start + at[hit]]
                marks[lists.place[s.start + at[hit]]] = True
            docs.append(new)
            scores.append(score)
            top = np.concatenate([top, score])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[-k:]
            if len(top) == k:
                kth = max(kth, int(top.min()))
        bound = 0
        for n, ((s, w), marks) in enumerate(zip(own, seen, strict=True)):
            rest = marks[best[n]:]
            gap = int(rest.argmin()) if len(rest) else 0
            best[n] = len(marks) if not len(rest) or rest[gap] else best[n] + gap
            # an ended list gives nothing more; else the next unmarked place bounds what is unseen no worse than the last marked
            if best[n] < len(marks):
                bound += w * int(lists.sorted_impact[s.start + max(0, best[n] - 1)]) if best[n] else w * int(lists.sorted_impact[s.start])
        if bound < kth or all(b == len(m) for b, m in zip(best, seen, strict=True)):
            break
        step = min(MOST_READ, 2 * step)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    found, score = np.concatenate(docs), np.concatenate(scores)
    met[found] = False
    keep = (score > 0) & (score >= kth)
    return found[keep], score[keep], sum(read)


def _item_blocks(items: DataFrame, item_col: str, text_col: str):
    """Lists of (row number, id, terms) on the driver, of at most BLOCK_CHARS characters (one item at least) each."""
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    block, size, number = [], 0, 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((number, r.id, sorted(set(words_of(r.text)))))
        size, number = size + len(r.text), number + 1
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item id, ``rank`` from 1, document id, ``score``.

    Terms, weights and scores are whole numbers as in the module's functions; equal scores are ranked by ascending id, null ids last. Every row of
    the items is an item of its own, and every row of the documents a document. Null and empty texts hold no terms and don't count as documents;
    items without terms and documents without a shared term give no rows; empty tables give none. Other columns are left out.

    Items come to the driver in blocks of bounded size, each block being one search. Documents are read once for a block, their counts of the
    items' terms stored; shards are built from what a task reads, and only ``k`` rows for each item and task are shuffled.
    """
    key, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    item_name = item_col if item_col != id_col else f"{item_col}_item"
    found = [_search(docs, block, k, id_col, text_col) for block in _item_blocks(items, item_col, item_text_col)]
    spark = docs.sparkSession
    schema = f"__item long, `{item_name}` {item_type.simpleString()}"
    out = []
    for block, rows in found:
        names = spark.createDataFrame([(n, i) for n, i, _ in block], schema)
        out.append(rows.join(F.broadcast(names), "__item").select(item_name, "rank", "__id", "score"))
    if not out:
        return spark.createDataFrame([], f"`{item_name}` {item_type.simpleString()}, rank int, `{id_col}` {key.simpleString()}, score long")
    total = out[0]
    for one in out[1:]:
        total = total.unionByName(one)
    return total.withColumnRenamed("__id", id_col)


def _search(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> tuple[list, DataFrame]:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in block for t in own}))}
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, get = len(vocabulary), vocabulary.get
        for whole in batches:
            for batch in arrow_rows(whole):
                lengths, found = [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    lengths.append(len(words))
                    found.append(np.array([i for i in map(get, words) if i is not None], np.int64))
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                keys, tf = np.unique(rows * width + np.concatenate(found), return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(found) + 1) * width).tolist()
                ids, tf = (keys % width).astype("<i4"), tf.astype("<i4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(lengths, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                    pa.array([tf[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["__id", "n", "terms", "tf"])

    counted = materialise(docs.select(id_col, text_col).mapInArrow(count, f"__id {id_type}, n long, terms binary, tf binary"), "zstd")
    totals = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    all_docs, all_terms = int(totals[0]), int(totals[1])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(x for x in batch.column(0).to_pylist() if x), "<i4"), minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("<i4")), pa.array(df[held])], ["term", "df"])

    # one row for each term of the block
    df = {r.term: r.df for r in counted.select("terms").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weighted = [(n, [(i, weight(all_docs, df[i])) for i in (vocabulary[t] for t in own) if i in df]) for n, _, own in block]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # an item's best so far in this task: numbers in ``ids``, scores
        ids, shard, postings = None, [], 0

        def close() -> None:
            nonlocal ids, shard, postings
            rows = pa.Table.from_batches(shard).combine_chunks()
            sizes = np.array([len(x) // 4 for x in rows.column("terms").to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            term = np.frombuffer(b"".join(rows.column("terms").to_pylist()), "<i4")
            tf = np.frombuffer(b"".join(rows.column("tf").to_pylist()), "<i4").astype(np.int64)
            n = rows.column("n").to_numpy()
            lists = Lists(doc, term, impacts(tf, n[doc], all_docs, all_terms))
            met = np.zeros(len(sizes), bool)
            own = rows.column("__id").combine_chunks()
            kept = len(ids) if ids is not None else 0
            ids = own if ids is None else pa.concat_arrays([ids, own])
            # the rank of each id, nulls last: what ties are cut by
            rank = np.empty(len(ids), np.int64)
            rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            for number, asked in weighted:
                old, old_scores = best.get(number, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                kth = int(old_scores.min()) if len(old_scores) == k else 0
                found, scores, _ = best_positions(lists, asked, k, kth, met)
                found, scores = np.concatenate([old, found + kept]), np.concatenate([old_scores, scores])
                order = np.lexsort((rank[found], -scores))[:k]
                best[number] = found[order], scores[order]
            # only the ids still in use go on
            used = np.unique(np.concatenate([f for f, _ in best.values()])) if best else np.zeros(0, np.int64)
            ids = ids.take(pa.array(used))
            for number, (f, s) in best.items():
                best[number] = np.searchsorted(used, f), s
            shard, postings = [], 0

        for whole in batches:
            for batch in arrow_rows(whole, 1024):
                shard.append(batch)
                postings += sum(len(x) for x in batch.column(2).to_pylist()) // 4
                if postings >= SHARD_POSTINGS:
                    close()
        if shard:
            close()
        for number, (f, s) in best.items():
            if len(f):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), number)), ids.take(pa.array(f)), pa.array(s)], ["__item", "__id", "score"])

    top = counted.filter("n > 0 AND octet_length(terms) > 0").mapInArrow(answer, f"__item long, __id {id_type}, score long")
    order = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_last("__id"))
    return block, top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
