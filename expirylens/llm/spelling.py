"""Spelling variant grouping: blocked Gram matrices of letter counts propose pairs of words, edits verify them.

Words of equal letter counts lie in one *cell*: their length and their numbers of letters in four classes. One inserted
letter adds one to the length and to one class; one replaced letter moves at most one from a class to another. So
a cell meets itself, four cells of the next length and six of its own length, and nothing else. Cells are cut into blocks
of bounded size, and for two blocks a matrix product of their letter counts gives all squared distances.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from expirylens.llm.common import arrow_rows, materialise

CLASSES = 4
# Columns of the letter-count matrix; a letter counts in the column of its code modulo this prime.
COLUMNS = 97
# Words and characters of a block on average, and cells of a distance matrix that are in memory at once.
BLOCK_WORDS, BLOCK_CHARS, TILE = 2048, 1 << 20, 1 << 22
# Parts into which a cell's words are dealt where they meet the cell's facts.
SALTS = 32
# Different words that a task counts before it passes them on.
COUNTED_WORDS = 400_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                damage: int | None = None) -> DataFrame:
    """``word`` and ``n``: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in lower case.

    With ``damage``, one letter is taken from every run whose crc32 of ``<id>:<run>`` that number divides: the one at
    that crc32 modulo the run's length. Only words of at least ``least_length`` letters and ``least_count`` occurrences
    are returned. Null texts hold no words; a null id is written as nothing; repeated rows count each; an empty
    table gives no rows; other columns are left out. Every task counts before anything is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        # Latin-1 letters as single bytes; a shorter run can't give a word
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % max(1, least_length))
        utf8: dict[bytes, bytes] = {}

        def passed_on():
            words = list(counts)
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()
            return found

        crc = zlib.crc32
        for whole in batches:
            for batch in arrow_rows(whole):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # a code point outside Latin-1 becomes a question mark, which is no letter
                    own = Counter(runs.findall((text or "").encode("latin-1", "replace").lower()))
                    if damage is None:
                        counts.update(own)
                        continue
                    before = crc(f"{'' if doc is None else doc}:".encode())
                    for word, n in own.items():
                        if word.isascii():
                            h = crc(word, before)
                        else:
                            data = utf8.get(word)
                            if data is None:
                                if len(utf8) > COUNTED_WORDS:
                                    utf8.clear()
                                data = utf8[word] = word.decode("latin-1").encode()
                            h = crc(data, before)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                    if len(counts) > COUNTED_WORDS:
                        yield passed_on()
        if counts:
            yield passed_on()

    parts = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one row each, filled up with zeros; and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<i4")
    return out, lengths


def letter_counts(letters: np.ndarray, lengths: np.ndarray, columns: int) -> np.ndarray:
    """How often each column's letters stand in each word."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = letters[np.arange(letters.shape[1]) < lengths[:, None]] % columns
    return np.bincount(rows * columns + places, minlength=len(lengths) * columns).reshape(len(lengths), columns)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of equal length, or rows of ``b`` one longer: whether exactly one edit tells each pair apart."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    left, right = a != b[:, :n], a != b[:, 1:]
    first = np.where(left.any(1), left.argmax(1), n)  # equal before it
    last = np.where(right.any(1), n - right[:, ::-1].argmax(1), 0)  # from there on equal, moved by one
    return last <= first


def near(a: list[str], b: list[str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words one edit apart: between two blocks, or once for each pair inside one (``b`` is None).

    Words of a block have one length; those of ``b`` the same or one more.
    """
    inside, b = b is None, a if b is None else b
    (left, n), (right, m) = codes(a), codes(b)
    # products are exact in float32 up to 2^24 and in float64 up to 2^53
    kind = np.float32 if max(left.shape[1], right.shape[1]) < 4000 else np.float64
    x, y = letter_counts(left, n, COLUMNS).astype(kind), letter_counts(right, m, COLUMNS).astype(kind)
    y_norm = (y * y).sum(1)
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        part = x[at:at + step]
        distance = part @ y.T
        distance *= -2
        distance += (part * part).sum(1)[:, None]
        distance += y_norm
        i, j = np.nonzero(distance <= 2)
        i += at
        if inside:
            i, j = i[i < j], j[i < j]
        wide = max(1, TILE // max(1, right.shape[1]))
        for k in range(0, len(i), wide):
            p, q = i[k:k + wide], j[k:k + wide]
            true = one_edit(left[p], right[q])
            if true.any():
                yield p[true], q[true]


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: both orders of every two words that one inserted, deleted or replaced code point tells apart.

    ``words`` are different, with their counts ``n``; null and empty words take no part. Blocks are bounded in words and characters
    by hashing the words of a full cell into several; all pairs of blocks of neighbouring cells are multiplied, so no pair is lost.
    """
    place = ["size", *[f"c{k}" for k in range(CLASSES)]]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, 4096):
                size = np.array([len(w) for w in batch.column(0).to_pylist()], np.int64)
                # a few very long words are not spread over a matrix of all
                kinds = np.array([np.bincount((np.frombuffer(w.encode("utf-32-le"), "<i4") % COLUMNS) % CLASSES, minlength=CLASSES)
                                  for w in batch.column(0).to_pylist()], np.int64).reshape(len(size), CLASSES)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), *[pa.array(kinds[:, k]) for k in range(CLASSES)]], ["word", "n", *place])

    known = words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL AND word <> ''")
    placed = materialise(known.mapInArrow(cells, "word string, n long, " + ", ".join(f"{p} long" for p in place)))
    parts = F.greatest(F.lit(1.0), F.ceil(F.count("*") / BLOCK_WORDS), F.ceil(F.sum("size") / BLOCK_CHARS)).cast("int")
    sizes = materialise(placed.groupBy(place).agg(parts.alias("parts")))
    # a cell may hold much of the vocabulary: its words meet its number of blocks by salt, then go by block
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("word", F.lit(1)), F.lit(SALTS)).cast("int"))
    salts = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = materialise(salted.join(salts, [*place, "salt"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
                         .groupBy(*place, "block").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")))

    def moved(length: int, **by: int):
        return F.struct((F.col("size") + length).alias("size"), *[(F.col(c) + by.get(c, 0)).alias(c) for c in place[1:]])

    inserted = [moved(1, **{c: 1}) for c in place[1:]]
    replaced = [moved(0, **{c: -1, d: 1}) for k, c in enumerate(place[1:]) for d in place[2 + k:]]
    meet = sizes.select(*[F.col(c).alias(f"a_{c}") for c in place], F.col("parts").alias("a_parts"),
                        F.explode(F.array(moved(0), *inserted, *replaced)).alias("to"))
    meet = meet.join(sizes, [F.col(f"to.{c}") == F.col(c) for c in place])
    same = F.lit(True)
    for c in place:
        same &= F.col(f"a_{c}") == F.col(c)
    meet = (meet.withColumn("same", same).withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
            .withColumn("block", F.explode(F.sequence(F.when(F.col("same"), F.col("a_block")).otherwise(0), F.col("parts") - 1))))
    own = blocks.select(*[F.col(c).alias(f"a_{c}") for c in [*place, "block"]], F.col("words").alias("a_words"), F.col("counts").alias("a_counts"))
    alone = F.col("same") & (F.col("a_block") == F.col("block"))
    pairs = (meet.join(own, [f"a_{c}" for c in [*place, "block"]]).join(blocks, [*place, "block"])
             .select(alone.alias("alone"), "a_words", "a_counts", "words", "counts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, 1):
                (alone,), (a,), (a_n,), (b,), (b_n,) = (c.to_pylist() for c in batch.columns)
                a_n, b_n = np.array(a_n, np.int64), np.array(b_n, np.int64)
                for i, j in near(a, None if alone else b):
                    left, right = pa.array([a[k] for k in i], pa.string()), pa.array([b[k] for k in j], pa.string())
                    yield pa.RecordBatch.from_arrays([left, pa.array(a_n[i]), right, pa.array(b_n[j])], ["word", "n", "near", "near_n"])
                    yield pa.RecordBatch.from_arrays([right, pa.array(b_n[j]), left, pa.array(a_n[i])], ["word", "n", "near", "near_n"])

    return pairs.mapInArrow(compare, "word string, n long, near string, near_n long")


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each of the different ``words`` with counts ``n``.

    A word's form is its near word of the largest count (of equal ones the first in code-point order), if that count is at least ``factor``
    times the word's own; else null. The root is reached by following forms, the word itself where it has none; counts grow
    along that way, so it ends, and it is halved in every round. An empty table gives no rows.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    forms = materialise(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")).alias("form_n")))
    links = materialise(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("to")))
    while True:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if links.join(on, "to").isEmpty():
            break
        links = materialise(links.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
