import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from expirylens.llm import spelling


def plain_counts(rows, damage):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def edits_are_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain_groups(n, factor=5):
    near = {w: [v for v in n if edits_are_one(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_counts_and_groups_equal_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 40)  # several blocks a cell
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_counts([(r.doc_id, r.text) for r in docs.collect()], 199)
    words = spelling.word_counts(docs, damage=199)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 300
    assert rows_of(spelling.group_variants(words)) == plain_groups(want)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(9, "ÉtéLong×x" * 5 + " ÀÉÎÕÜß " * 6 + "StraßeK" * 7 + "x" * 70000)], "doc_id long, text string"), allowMissingColumns=True)
    for damage in (None, 2, 199):
        want = plain_counts([(r.doc_id, r.text) for r in docs.collect()], damage)
        words = spelling.word_counts(docs, damage=damage)
        assert {r.word: r.n for r in words.collect()} == want and want
        assert rows_of(spelling.group_variants(words)) == plain_groups(want)
    assert spelling.group_variants(spelling.word_counts(no_docs)).count() == 0


def test_chains_ties_and_any_letters(spark):
    n = {"colour": 1000, "color": 100, "colo": 10, "col": 1, "coloor": 100, "漢字漢字": 50, "漢字漢": 5, "漢字字漢": 50, "😀a": 9, "😀b": 90, "a" * 9000: 5, "a" * 9001: 50,
         "ab": 7, "ba": 70, "x": 1, "y": 5}
    words = spark.createDataFrame([*n.items(), (None, 4), ("", 9)], "word string, n long").filter("word IS NULL OR word <> ''")
    got = {r.word: r for r in spelling.group_variants(words.filter("word IS NOT NULL")).collect()}
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.values()) == plain_groups(n)
    assert got["col"].form == "colo" and got["col"].root == "colour"
    assert got["a" * 9000].form == "a" * 9001


@given(st.lists(st.text(st.sampled_from("abcé漢\U0001F600"), min_size=1, max_size=7), min_size=1, max_size=40, unique=True))
@settings(max_examples=80, deadline=None)
def test_blocks_find_all_pairs_of_one_edit(words):
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    got = set()
    for n, own in by_size.items():
        for i, j in spelling.near(own, None):
            got |= {frozenset((own[a], own[b])) for a, b in zip(i, j, strict=True)}
        if longer := by_size.get(n + 1):
            for i, j in spelling.near(own, longer):
                got |= {frozenset((own[a], longer[b])) for a, b in zip(i, j, strict=True)}
    assert got == {frozenset((a, b)) for a in words for b in words if a != b and edits_are_one(a, b)}


@pytest.mark.parametrize("a,b", [("abcd", "abxd"), ("abcd", "abccd"), ("abcd", "xabcd"), ("abcd", "abcdx"), ("abcd", "badc"), ("aaaa", "aaaaa")])
def test_one_edit(a, b):
    x, y = spelling.codes([a])[0], spelling.codes([b])[0]
    assert bool(spelling.one_edit(x, y)[0]) == edits_are_one(a, b)
    assert np.array_equal(spelling.letter_counts(x, np.array([len(a)]), 97).sum(1), [len(a)])
