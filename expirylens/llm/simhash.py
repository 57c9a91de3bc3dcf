"""SimHash near-duplicates: fingerprints, links within a few differing bits, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from expirylens.llm.common import arrow_rows, materialise
from expirylens.llm.components import components
from expirylens.llm.gray_index import GrayIndex, unite

SEED = 42
# A (band, value) group with more distinct fingerprints than this is dealt out again by further bands, and what
# is still larger, or has no further bands, is cut into blocks of half the size that are searched in pairs.
GROUP_LIMIT = 1 << 14
# Routed rows searched at once in a task.
CHUNK = 1 << 14
# Least hashes that make one route.
ROUTE_ROWS = 4
# Texts and bytes of shingles in a block of a proposed class, blocks of a class unless the bytes need more.
CHECK_ROWS, CHECK_BYTES, CHECK_BLOCKS = 128, 1 << 23, 64
# Up to as many hot groups (12 bytes each) are sent to all executors; beyond it they are joined by a shuffle.
HOT_BROADCAST = 100_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.array([h(text[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)], np.uint64)


def widen(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words for each hash: the hash itself, then mixes of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The 64-bit words whose bits are set in over half of the hashes; zero without hashes."""
    if not len(h):
        return np.zeros(words, np.uint64)
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255 * 32):
        bits = np.unpackbits(np.ascontiguousarray(widen(h[at:at + 255 * 32], words)).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            total += np.add.reduce(bits[k:k + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)


def differing_bits(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of sets of that Jaccard similarity, and of like size, differ on average.

    A bit differs with the probability angle / pi, where the cosine of two such sets is 2 s / (1 + s).
    """
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def proposing_bits(similarity: float, bits: int) -> int:
    """Differing bits up to which pairs are proposed as being of that Jaccard similarity or more.

    Six standard errors over the mean. The mean is higher for very short texts (3/16 of the bits for 4 shingles of 5).
    """
    mean = differing_bits(similarity, bits)
    return round(mean + 6 * math.sqrt(mean * (bits - mean) / bits))


def least_routes(h: np.ndarray, routes: int, rows: int = ROUTE_ROWS) -> list[int]:
    """For each route a number of 63 bits that sums up the least values of ``rows`` mixes of the hashes.

    Two sets share a route with the probability s ** rows, where s is their Jaccard similarity.
    """
    if not len(h):
        return [0] * routes
    mixes = np.random.default_rng(SEED).integers(0, 1 << 64, (2, routes * rows), dtype=np.uint64)
    low = np.full(routes * rows, ~np.uint64(0))
    for at in range(0, len(h), 1024):
        np.minimum(low, ((h[at:at + 1024, None] ^ mixes[0]) * (mixes[1] | np.uint64(1))).min(0), out=low)
    return [xxhash.xxh64_intdigest(r.tobytes(), SEED) >> 1 for r in low.reshape(routes, rows)]


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 bits: int = 64, routes: int = 0) -> DataFrame:
    """(id, fingerprint): big-endian binary of ``bits`` bits, over word shingles of the whole text.

    A-Z are lower-cased; words are what white space (blank, tab to carriage return) parts. A text of
    fewer words than a shingle counts as one shingle, a null or empty one has the fingerprint zero.
    With ``routes`` the shingles are a set, without repeats, and there is also ``routes``: so many numbers
    (``least_routes``) that sets of a high Jaccard similarity have in common.
    """
    width = bits // 64
    fields = [docs.schema[id_col].simpleString().replace(":", " ", 1), "fingerprint binary"] + ["routes array<long>"] * bool(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands = [], []
            for text in batch.column(1):
                hashes = shingle_hashes(_words(text.as_py()), shingle)
                if routes:
                    hashes = np.unique(hashes)
                    bands.append(least_routes(hashes, routes))
                prints.append(majority(hashes, width).astype(">u8").tobytes())
            columns = [batch.column(0), pa.array(prints, pa.binary())] + [pa.array(bands, pa.list_(pa.int64()))] * bool(routes)
            yield pa.RecordBatch.from_arrays(columns, [id_col, "fingerprint"] + ["routes"] * bool(routes))

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(fields))


def _pieces(bits: list[int], pieces: int) -> list[list[int]]:
    return [bits[len(bits) * k // pieces:len(bits) * (k + 1) // pieces] for k in range(pieces)]


def _value(number: int, bits: list[int]) -> int:
    out = 0
    for b in bits:
        out = out << 1 | number >> b & 1
    return out


def _block_pairs(print_: bytes, blocks: int) -> list[int]:
    """Numbers from 1 on of the block pairs that a row belongs to; any two rows share one. Zero if there is one block."""
    if blocks < 2:
        return [0]
    own = xxhash.xxh64_intdigest(print_, SEED) % blocks
    return [1 + min(own, k) * blocks + max(own, k) for k in range(blocks) if k != own]


def _marked(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the columns of the hot keys, null for others."""
    few = hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST
    return rows.join(F.broadcast(hot) if few else hot, keys, "left")


def _routed(distinct: DataFrame, bits: int, max_diff: int, own_routes: bool) -> DataFrame:
    """(band, value, band2, value2, pair, fingerprint): fingerprints that may be linked agree in all but the last once at least.

    Without own routes these are ``max_diff`` + 1 bands of the fingerprint: of two fingerprints that differ
    in ``max_diff`` bits or fewer, one band is equal. A band value with too many fingerprints is dealt
    again in the same way by the other bits. A group with own routes that is too large, and one that still is after
    the second deal, is cut into blocks; each pair of blocks is a group of its own, so every pair of the group meets.
    """
    bands = _pieces(list(range(bits)), max_diff + 1) if not own_routes else []
    keys = ["band", "value", "band2", "value2"]

    def first(batches):
        for batch in batches:
            rows = [(k, _value(n, b), p) for p in batch.column(0).to_pylist() for n in [int.from_bytes(p)] for k, b in enumerate(bands)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["band", "value", "fingerprint"])

    def again(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not row["count"]:
                    out.append((row["band"], row["value"], 0, 0, row["fingerprint"]))
                else:
                    n, used = int.from_bytes(row["fingerprint"]), set(bands[row["band"]])
                    rest = _pieces([b for b in range(bits) if b not in used], max_diff + 1)
                    out += [(row["band"], row["value"], 1 + k, _value(n, b), row["fingerprint"]) for k, b in enumerate(rest)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [*keys, "fingerprint"])

    def cut(batches):
        for batch in batches:
            blocks = [-(-2 * (c or 0) // GROUP_LIMIT) for c in batch.column(5).to_pylist()]
            pairs = [_block_pairs(p, n) for p, n in zip(batch.column(4).to_pylist(), blocks, strict=True)]
            at = pa.array(np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(4)], pa.array([k for p in pairs for k in p], pa.int64()), batch.column(4).take(at)], [*keys, "pair", "fingerprint"])

    def over(rows: DataFrame, by: list[str]) -> DataFrame:
        return materialise(rows.groupBy(*by).count().filter(F.col("count") > GROUP_LIMIT))

    if own_routes:
        rows = distinct.select(F.posexplode("routes").alias("band", "value"), "fingerprint").withColumns({"band2": F.lit(0), "value2": F.lit(0).cast("long")})
        hot = over(rows, keys)
    else:
        rows = distinct.select("fingerprint").mapInArrow(first, "band int, value long, fingerprint binary")
        hot = over(rows, ["band", "value"])
        rows = _marked(rows, hot, ["band", "value"]).mapInArrow(again, "band int, value long, band2 int, value2 long, fingerprint binary")
        if not hot.isEmpty():
            hot = over(rows.filter("band2 > 0"), keys)
    if hot.isEmpty():
        return rows.select(*keys, F.lit(0).cast("long").alias("pair"), "fingerprint")
    return _marked(rows, hot, keys).select(*keys, "fingerprint", "count").mapInArrow(cut, "band int, value long, band2 int, value2 long, pair long, fingerprint binary")


def _links(routed: DataFrame, bits: int, max_diff: int) -> DataFrame:
    """(a, b): fingerprints joined into trees, one tree for each set that links connect inside a group."""
    keys = ["band", "value", "band2", "value2", "pair"]

    def search(key: np.ndarray, prints: list[bytes]):
        words = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), bits // 64)
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]).any(1)))
        several = np.bincount(group)[group] > 1
        if not several.any():
            return None
        rows = np.flatnonzero(several)
        parent = np.arange(len(rows))
        for i, j in GrayIndex(words[rows], group[rows]).pairs(max_diff):
            unite(parent, i, j)
        linked = np.flatnonzero(parent != np.arange(len(rows)))
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array([prints[rows[i]] for i in linked], pa.binary()), pa.array([prints[rows[parent[i]]] for i in linked], pa.binary())], ["a", "b"])

    def run(batches):
        key, prints = np.zeros((0, 5), np.int64), []
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)])
            prints += batch.column(5).to_pylist()
            if len(prints) < CHUNK:
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cuts):
                if (out := search(key[:cuts[-1]], prints[:cuts[-1]])) is not None:
                    yield out
                key, prints = key[cuts[-1]:], prints[cuts[-1]:]
        if prints and (out := search(key, prints)) is not None:
            yield out

    return routed.repartition(*keys).sortWithinPartitions(*keys, "fingerprint").mapInArrow(run, "a binary, b binary")


def exact_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of a Jaccard similarity of ``least`` or more that join the sets (sorted, without repeats) as all such pairs do."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, label, out = sizes[order], np.arange(len(sets)), []
    for i in range(1, len(sets)):
        own = sets[order[i]]
        left = np.arange(np.searchsorted(sizes, int(least * sizes[i])), i)
        while len(left := left[label[left] != label[i]]):
            j, left = left[0], left[1:]
            both = len(np.intersect1d(sets[order[j]], own, assume_unique=True))
            if both and both / (sizes[i] + sizes[j] - both) >= least:
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def _verified(docs: DataFrame, id_col: str, text_col: str, proposed: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b): fingerprints of one proposed class whose texts have that exact Jaccard similarity of shingles.

    ``proposed`` has (fingerprint, least_id, root). A class goes by blocks of texts, compared block against block: rows in a
    task are bounded, and a task hands on a tree over the linked fingerprints.
    """
    def shingles(batches):
        for batch in batches:
            for part in arrow_rows(batch):
                sets = [np.unique(shingle_hashes(_words(t.as_py()), shingle)).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["root", "fingerprint", "shingles"])

    def deal(batches):
        for batch in batches:
            for part in arrow_rows(batch):
                pairs = [_block_pairs(p, n or 1) for p, n in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)]
                for begin in range(0, max(map(len, pairs), default=0), 8):  # a few copies of long texts at a time
                    some = [p[begin:begin + 8] for p in pairs]
                    at = pa.array(np.repeat(np.arange(len(some)), [len(p) for p in some]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([k for p in some for k in p], pa.int64()), part.column(1).take(at), part.column(2).take(at)],
                                                     ["root", "pair", "fingerprint", "shingles"])

    def check(batches):
        key, prints, sets = None, [], []

        def links():
            if found := exact_links(sets, least):
                yield pa.RecordBatch.from_arrays([pa.array([prints[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for root, pair, print_, own in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if key != (root, pair):
                    yield from links()
                    key, prints, sets = (root, pair), [], []
                prints.append(print_)
                sets.append(np.frombuffer(own, np.uint64))
        yield from links()

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(proposed.withColumnRenamed("least_id", "__of"), F.col("__id") == F.col("__of"))
    rows = materialise(rows.select("root", "fingerprint", "text").mapInArrow(shingles, "root binary, fingerprint binary, shingles binary"))
    size = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles").cast("long")).alias("bytes"))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / CHECK_ROWS), F.lit(CHECK_BLOCKS)), F.ceil(F.col("bytes") / CHECK_BYTES)).cast("int")
    hot = materialise(size.filter((F.col("n") > 2 * CHECK_ROWS) | (F.col("bytes") > 2 * CHECK_BYTES)).select("root", blocks.alias("blocks")))
    dealt = _marked(rows, hot, ["root"]).select("root", "fingerprint", "shingles", "blocks").mapInArrow(deal, "root binary, pair long, fingerprint binary, shingles binary")
    return dealt.repartition("root", "pair").sortWithinPartitions("root", "pair", "fingerprint").mapInArrow(check, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64,
                    max_diff: int = 2, routes: int = 0, least: float = 0.0) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the least id that links can reach.

    Two texts are linked if their fingerprints differ in ``max_diff`` bits or fewer. Without ``routes`` all
    such links are found. With them the links between fingerprints that share one of the routes are found;
    this is for wide fingerprints, where the differing bits estimate a similarity. With ``least`` such links only propose
    classes: inside a proposed class, texts are linked if the exact Jaccard similarity of their shingles is ``least`` or more.
    Ids must then name single rows and not be null.

    Equal fingerprints are one node, so copies cost one row in the search however many there are; they are
    merged on the map side. Each search group is indexed in Gray order (``gray_index``), and a task hands on
    a tree over the linked fingerprints, never all pairs. Rows with equal ids are not merged, but ids name
    classes, so a repeated row is in its own class with itself. Empty and null texts link with each other
    like any texts. A class without any non-null id has a null component_id. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, bits, routes))
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"), *[F.min("routes").alias("routes")] * bool(routes)))
    links = _links(_routed(nodes, bits, max_diff, bool(routes)), bits, max_diff)
    classes = components(links, "a", "b")
    if least:
        proposed = nodes.select("fingerprint", "least_id").join(classes.withColumnRenamed("node", "fingerprint"), "fingerprint")
        classes = components(_verified(docs, id_col, text_col, proposed, shingle, least), "a", "b")
    of_node = (nodes.select("fingerprint", "least_id").join(classes.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
               .select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")))
    of_node = materialise(of_node)
    least = of_node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of_node.join(least, "root").select("fingerprint", "component_id")
    return prints.select(id_col, "fingerprint").join(named, "fingerprint").select(id_col, "fingerprint", "component_id")
