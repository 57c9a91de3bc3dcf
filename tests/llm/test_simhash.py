import re
from collections import defaultdict

import numpy as np
import xxhash

from expirylens.llm import simhash
from expirylens.llm.components import components
from expirylens.llm.gray_index import GrayIndex, gray_rank, unite


def fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """{id: component} by comparing every two fingerprints; rows: (id, fingerprint)."""
    parent = {f: f for _, f in rows}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    prints = sorted(parent)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i, f in rows:
        ids[find(f)].append(i)
    return {f: min((i for i in ids[find(f)] if i is not None), default=None) for f in prints}


def test_gray_rank_orders_the_gray_code():
    codes = np.array([[k ^ k >> 1] for k in range(64)], np.uint64)
    assert gray_rank(codes)[:, 0].tolist() == list(range(64))
    wide = np.array([[k >> 3, (k & 7) << 61] for k in range(64)], np.uint64)
    whole = np.array([[(k >> 3) << 3 | k & 7] for k in range(64)], np.uint64)
    assert np.lexsort(gray_rank(wide).T[::-1]).tolist() == np.argsort(gray_rank(whole)[:, 0]).tolist()


def test_index_finds_exactly_the_near_pairs_of_each_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    words = base[rng.integers(0, 60, 900)].copy()
    for _ in range(3):
        words[np.arange(900), rng.integers(0, 2, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    group = rng.integers(0, 5, 900)
    for limit in (0, 2, 6):
        got = {tuple(sorted(p)) for i, j in GrayIndex(words, group).pairs(limit) for p in zip(i.tolist(), j.tolist())}
        want = {(i, j) for i in range(900) for j in range(i + 1, 900) if group[i] == group[j] and np.bitwise_count(words[i] ^ words[j]).sum() <= limit}
        assert got == want


def test_unite():
    parent = np.arange(8)
    unite(parent, np.array([7, 5, 3]), np.array([5, 3, 1]))
    assert parent.tolist() == [0, 1, 2, 1, 4, 1, 6, 1]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_the_query_against_brute_force(spark, sf):
    from expirylens.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = brute(list(prints.items()))
    rows = QUERIES["op8_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", want[f]) for i, f in prints.items()}


def test_near_fingerprints_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(40, 4, replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(0, 1 << 62, 40)})
    df = spark.createDataFrame([(p.to_bytes(8),) for p in prints], "fingerprint binary")
    links = simhash._links(simhash._routed(df, 64, 2, False), 64, 2)
    root = dict(components(links, "a", "b").collect())
    want = brute(list(zip(prints, prints)))
    by_root = defaultdict(set)
    for p in prints:
        by_root[bytes(root.get(p.to_bytes(8), p.to_bytes(8)))].add(p)
    classes = defaultdict(set)
    for p in prints:
        classes[want[p]].add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, classes.values()))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    want = brute([(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()])
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.fingerprint).hex(), r.component_id) for r in rows)
    assert got == sorted((r.doc_id is None, r.doc_id, f"{fingerprint(r.text):016x}", want[fingerprint(r.text)]) for r in odd_docs.collect())
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs, bits=512, max_diff=78, routes=20).count() == 0


def test_wide_fingerprints_find_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs, copies = [], []
    for i in range(150):
        words = [vocabulary[k] for k in rng.integers(0, 4000, 200)]
        docs.append((2 * i, " ".join(words)))
        for k in rng.choice(200, 2, replace=False):  # two of 200 words: a similarity of about 0.9
            words[k] = "changed"
        copies.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(docs + copies, "doc_id long, text string")
    limit = simhash.differing_bits(0.8, 512)
    rows = simhash.near_duplicates(df, shingle=5, bits=512, max_diff=limit, routes=20).collect()
    assert sum(r.component_id == r.doc_id // 2 * 2 for r in rows) >= 0.98 * len(rows)
    assert all(r.component_id in (r.doc_id, r.doc_id // 2 * 2) for r in rows)


def jaccard(a, b, size=5):
    a, b = ({tuple(t.lower().split()[k:k + size]) for k in range(max(1, len(t.split()) - size + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_at_the_threshold_are_exact(spark):
    """Pairs on both sides of 0.8, and close to it: new words at places, new text at the end, very short texts."""
    rng = np.random.default_rng(8)
    docs = []
    for i in range(240):
        n = int(rng.choice([8, 9, 13, 40, 150, 400]))
        words = [f"d{i}w{k}" for k in range(n)]
        docs.append(" ".join(words))
        if i % 2:
            words += [f"d{i}new{k}" for k in range(max(1, round((n - 4) * rng.uniform(0.15, 0.35))))]
        else:
            for k in rng.choice(n, max(1, round(n * rng.uniform(0.01, 0.035))), replace=False):
                words[k] = f"d{i}other{k}"
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = simhash.near_duplicates(df, shingle=5, bits=512, max_diff=simhash.proposing_bits(0.8, 512), routes=20, least=0.8).collect()
    got = {r.doc_id for r in rows if r.component_id != r.doc_id}
    want = {i + 1 for i in range(0, len(docs), 2) if jaccard(docs[i], docs[i + 1]) >= 0.8}
    assert got == want and 60 < len(want) < 200


def test_hot_groups_with_routes_lose_no_link(spark, monkeypatch):
    """Fingerprints that share one route only, in a group over the limit; groups that are still large after the second deal."""
    rng = np.random.default_rng(9)
    base = [int.from_bytes(rng.bytes(64)) for _ in range(150)]
    prints = base + [p ^ 1 << int(rng.integers(512)) for p in base]
    df = spark.createDataFrame([(p.to_bytes(64), [7, 1000 + k]) for k, p in enumerate(prints)], "fingerprint binary, routes array<long>")

    def links():
        return dict(components(simhash._links(simhash._routed(df, 512, 78, True), 512, 78), "a", "b").collect())

    whole = links()
    assert len(whole) == 300
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 16)
    assert links() == whole
    routed = simhash._routed(df, 512, 78, True).groupBy("band", "value", "band2", "value2", "pair").count().toPandas()
    assert routed["count"].max() < 40
    near = spark.createDataFrame([(k.to_bytes(8),) for k in range(200)], "fingerprint binary")
    routed = simhash._routed(near, 64, 2, False).groupBy("band", "value", "band2", "value2", "pair").count().toPandas()
    assert routed["count"].max() < 40


def test_large_proposed_classes_are_checked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHECK_ROWS", 4)
    words = [f"w{k}" for k in range(100)]
    docs = []
    for i in range(60):  # each is near to the one before it only
        words[i:i + 1] = [f"new{i}"]
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = simhash.near_duplicates(df, shingle=5, bits=512, max_diff=simhash.proposing_bits(0.8, 512), routes=20, least=0.8).collect()
    assert {r.component_id for r in rows} == {0} and len(rows) == 60
