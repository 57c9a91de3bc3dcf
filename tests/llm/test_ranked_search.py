import math
import re
from collections import Counter

import numpy as np
import pytest

from expirylens.llm import queries, ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    """All scores, in plain Python."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, df = sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * len(counted) // total
            s = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def both(spark, docs, items, k):
    got = rows_of(R.search(docs, items, k))
    assert got == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    return got


@pytest.mark.parametrize("postings,first,most", [(3_000_000, 64, 4096), (4000, 1, 1), (300, 3, 8)])
def test_equal_to_scoring_everything(spark, sf, monkeypatch, postings, first, most):
    monkeypatch.setattr(R, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(R, "FIRST_READ", first)
    monkeypatch.setattr(R, "MOST_READ", most)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
    assert len(both(spark, docs, items, 50)) > 300
    both(spark, docs, items, 3)


def test_odd_rows_and_ties(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(R, "SHARD_POSTINGS", 30)
    same = spark.createDataFrame([(i, "tied words İstanbul naïve K42") for i in (9, 30, 12, 11, 10, 31)] + [(40, "tied"), (41, "\x1ctied\x7fwords_more"), (42, "!!!")], "doc_id long, text string")
    docs = odd_docs.unionByName(same, allowMissingColumns=True)
    items = spark.createDataFrame([(1, "TIED Words", "c"), (2, "alpha quiet river one", "c"), (2, "alpha quiet river one", "c"), (3, None, "c"), (4, "", "c"), (None, "id at all", "c"),
                                   (5, "zzz", "c"), (6, "İstanbul NAÏVE naïve k42", "c"), (7, "the the the", "c")], "item_id long, text string, doc_id string")
    both(spark, docs, items.drop("doc_id"), 4)
    got = both(spark, docs, items.drop("doc_id"), 100)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1][:6] == [9, 10, 11, 12, 30, 31]
    assert rows_of(R.search(docs, items, 4)) == rows_of(R.search(docs, items.drop("doc_id"), 4))
    assert R.search(no_docs, items, 4).count() == 0 and R.search(docs, items.limit(0), 4).count() == 0
    monkeypatch.setattr(R, "BLOCK_CHARS", 20)
    both(spark, docs, items.drop("doc_id"), 4)


def test_reading_stops_early_and_never_too_early():
    rng = np.random.default_rng(3)
    for trial in range(40):
        docs, terms = 3000, 6
        held = rng.random((terms, docs)) < rng.uniform(0.02, 0.6, (terms, 1))
        impact = rng.integers(1, 50 if trial % 2 else 10**6, (terms, docs)) * held
        t, d = np.nonzero(impact)
        order = rng.permutation(len(t))
        lists = R.Lists(d[order].astype(np.int32), t[order].astype(np.int32), impact[t, d][order].astype(np.int64))
        item = [(k, int(rng.integers(0, 40))) for k in range(terms)]
        want = sum(w * impact[k] for k, w in item)
        met = np.zeros(docs, bool)
        found, scores, read = R.best_positions(lists, item, 10, 0, met)
        assert not met.any() and np.array_equal(scores, want[found])
        kth = np.sort(want)[-10]
        assert set(np.flatnonzero((want > 0) & (want >= kth))) <= set(found.tolist())  # with every tie
        assert read <= held.sum()
    lists = R.Lists(np.arange(100_000), np.zeros(100_000, int), np.arange(100_000)[::-1] + 1)
    found, _, read = R.best_positions(lists, [(0, 1)], 5, 0, np.zeros(100_000, bool))
    assert found.tolist() == [0, 1, 2, 3, 4] and read == R.FIRST_READ


def test_query(spark, sf):
    rows = queries.op13_search(spark, sf)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and dict(rows.dtypes)["rank"] == "int"
