"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ in k edits is cut into k + 1 pieces. Wherever a text holds the item within k
edits, one piece at least stands there unchanged. Piece hits are found by one automaton over all pieces,
and each is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from expirylens.llm.common import materialise

ERROR_RATE = 0.08
# Characters of test items that one pass over the documents looks for; larger sets take several passes.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, white space as single blanks, none at the ends."""
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits that a test item of so many characters may differ in."""
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits`` + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(pattern: str, text: str, limit: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern with any part of the text, or with a beginning of it
    if anchored; None if it is over the limit.

    Myers' bit vectors: one addition and a few logical operations on pattern-wide integers for each character.
    Ties go to the earliest end.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = equal.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        down = eq | minus
        rise = minus | (full & ~(across | plus))
        fall = plus & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1 | anchored) & full, fall << 1 & full
        plus, minus = fall | (full & ~(down | rise)), rise & down
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def locate(item: str, text: str, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best place in the text, within the edits."""
    found = best_end(item, text, edits)
    if found is None:
        return None
    distance, end = found
    back = best_end(item[::-1], text[:end][::-1], distance, anchored=True)
    return distance, end - back[1], end


class Matcher:
    """All items, one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, budget(len(text), rate)) for key, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str):
        """(item number, distance, start, end): each item's best place in a normalised text; ties to the first place."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        for n, found in starts.items():
            _, item, edits = self.items[n]
            best = None
            runs, left = [], sorted(found)
            for s in left:  # hits of one place shift by the edits at most
                if runs and s - runs[-1][1] <= 2 * edits:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for a, b in runs:
                low = max(0, a - edits)
                got = locate(item, text[low:b + len(item) + edits], edits)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[1] + low, got[2] + low)
            if best:
                yield n, *best


def original_places(text: str) -> list[int]:
    """For each character of the normalised text, its place in the text as given."""
    out, gap = [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = bool(out)
            continue
        if gap:
            out.append(i - 1)
            gap = False
        out += [i] * len(c.lower())
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (id, normalised text) of at most BLOCK_CHARS characters (one item at least) on the driver at a time."""
    kept = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    size = F.length("text").cast("long")
    total = kept.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    if count <= 1:
        yield [(r.id, t) for r in kept.collect() if (t := normalise(r.text))]
        return
    # hashed parts of half a block on average; a part that is over a block all the same goes in turn by its ids
    parts = 2 * count
    kept = materialise(kept.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")).withColumn(
        "to", F.sum(size).over(Window.partitionBy("part").orderBy(F.xxhash64("id", "text"), "id", "text"))).withColumn("piece", F.floor(F.col("to") / BLOCK_CHARS)))
    for r in kept.select("part", "piece").distinct().orderBy("part", "piece").collect():
        own = kept.filter((F.col("part") == r.part) & (F.col("piece") == r.piece)).collect()
        if block := [(x.id, t) for x in own if (t := normalise(x.text))]:
            yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """One row for each (document, item) where the document holds the whole item within its edit budget.

    Columns: id, item id, distance, allowed, start, end: the best place (the first of equals) and its span
    in the text as given. Texts are compared in lower case with single blanks. The budget is ``rate``
    times the item's length, rounded down.

    Items without visible characters and null items match nothing; null and empty texts hold nothing.
    Equal items under several ids each get a row; repeated documents each get theirs; equal (id, text)
    pairs of items count once. Empty tables give no rows. Items come to the driver in blocks of bounded size,
    and every block is one pass over the documents, which never move.
    """
    key, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_name = item_col if item_col != id_col else f"{item_col}_item"
    schema = f"`{id_col}` {key}, `{item_name}` {item_type}, distance int, allowed int, start long, end long"
    rows = docs.select(id_col, text_col)

    def search(block: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            if not block:
                return
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    text = text.as_py() or ""
                    places = None
                    for n, distance, start, end in matcher.find(normalise(text)):
                        places = places or original_places(text)
                        item = matcher.items[n]
                        at.append(i)
                        hits.append((item[0], distance, item[2], places[start], places[end - 1] + 1))
                if at:
                    columns = list(zip(*hits, strict=True))
                    kinds = (item_kind, pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                                                     [id_col, item_name, "distance", "allowed", "start", "end"])

        return rows.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(items.schema[item_col].dataType)
    found = None
    for block in _blocks(items, id_col=item_col, text_col=item_text_col):
        one = search(block)
        found = one if found is None else found.union(one)
    return found if found is not None else search([])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with all their columns. Every row of an id that holds one goes; null ids count as one id."""
    found = contaminated(docs, items, id_col, text_col, **options).select(id_col).distinct()
    bad = materialise(found)
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_col]), "left_anti")
