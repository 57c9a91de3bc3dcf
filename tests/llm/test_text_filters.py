import zlib

import numpy as np
import pytest

from expirylens.llm import decontamination as D, pii, toxicity


def distance_in(item, text):
    """Least edit distance of the item to any part of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_equals_the_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item = "".join(rng.choice(list("abc "), rng.integers(1, 90)))
        text = "".join(rng.choice(list("abc "), rng.integers(0, 120)))
        want = distance_in(item, text)
        got = D.best_end(item, text, len(item))
        assert (got[0] if got else len(item)) == want
        found = D.locate(item, text, len(item) - 1)
        if found:
            d, a, b = found
            assert d == want and distance_in(item, text[a:b]) == d


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind == 0:
            out[k] = "q"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "z")
    return "".join(out)


def test_every_item_within_its_budget_is_found_and_no_other(spark):
    rng = np.random.default_rng(4)
    words = ["river", "stone", "lamp", "orange", "window", "paper", "cloud", "seven", "garden", "slowly"]
    items = [(i, " ".join(rng.choice(words, rng.integers(8, 30)))) for i in range(25)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(words, 60))
        if i % 2:
            item = items[i % 25][1]
            text += "\n" + edited(rng, item, int(rng.integers(0, D.budget(len(item)) + 3))).upper() + "  " + text
        docs.append((i, text))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(df, it).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            d = distance_in(D.normalise(item), D.normalise(text))
            if d <= D.budget(len(D.normalise(item))):
                want[i, k] = d
    assert {k: r.distance for k, r in got.items()} == want
    texts = dict(docs)
    for (i, k), r in got.items():
        assert distance_in(D.normalise(items[k][1]), D.normalise(texts[i][r.start:r.end])) == r.distance


def test_decontamination_of_odd_rows_and_blocks(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "another text under the same id"), (2, None), (3, "  "), (4, "no id at all"), (5, "no id at all"), (4, "no id at all"), (6, "one")], "item_id int, text string")
    for size in (D.BLOCK_CHARS, 20):
        monkeypatch.setattr(D, "BLOCK_CHARS", size)
        got = sorted((str(r.doc_id), r.item_id, r.distance, r.start, r.end) for r in D.contaminated(odd_docs, items).collect())
        assert got == [("7", 1, 0, 0, 30), ("7", 6, 0, 0, 3), ("None", 4, 0, 0, 12), ("None", 5, 0, 0, 12)]
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(odd_docs, items.limit(0)).count() == 0
    left = D.clean(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 4


def test_decontamination_query_finds_all_planted_items(spark, sf):
    from expirylens.llm.queries import QUERIES
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op6_decontamination"](spark, sf).collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = D.normalise(d.text or "")
        for item in items:
            assert D.normalise(item.text) not in text or got[d.doc_id, item.item_id] == 0


def test_toxic_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an id1ot, you STUPID clown!! i.d.i.o.t m o r o n scuuuum"), strict=True))
    assert f["insults"] == 2 and f["near_second_person"] == 2 and f["disguised"] >= 4 and f["exclamations"] > 0
    assert toxicity.features("") == toxicity.features(" \n") == [0.0] * len(toxicity.FEATURES)
    assert len(toxicity.features("ñ " * 100_000)) == len(toxicity.FEATURES)


def test_toxicity_learns_only_outside_the_fold(spark):
    rng = np.random.default_rng(6)
    words = ["garden", "window", "paper", "cloud", "bread", "river"]
    docs, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        text = list(rng.choice(words, 40))
        if bad:
            for _ in range(3):
                text[int(rng.integers(0, 40))] = str(rng.choice(["idiot", "moron", "pathetic", "you", "m0ron"]))
        docs.append((i, " ".join(text)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(bad) if not held else 1 - int(bad)))  # wrong in the fold: must not matter
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(df, lab, trees=10).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {0.0}
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, one).collect()} == {1.0}
    assert toxicity.score(no_docs, one).count() == 0
    many = spark.createDataFrame([(i, f"text {i} " + ("idiot " * 5 if i % 2 else "fine ")) for i in range(200)], "doc_id long, text string")
    rows = toxicity.score(odd_docs.select("doc_id", "text").union(many), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"), trees=3).collect()
    assert len(rows) == odd_docs.count() + 200 and all(r.score is not None for r in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 73049])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel("k")
    some = range(min(size, 1000))
    image = [f.permute(v, size, "t") for v in some]
    assert len(set(image)) == len(image) and all(0 <= v < size for v in image)
    if size == 1000:
        assert image != list(some) and image != [pii.Feistel("other").permute(v, size, "t") for v in some]


def test_pseudonyms_keep_format_and_link():
    f = pii.Feistel("k")
    text = ("mail Ann.Lee+9@Mail-7.example.com; again ann.lee+9@mail-7.example.com, card 4111 1111 1111 1111 or 4111111111111111, bad 4111111111111112, "
            "iban DE89 3704 0044 0532 0130 00, born 1987-02-28 and 28.02.1987, not 1987-02-30, ip 10.0.255.7, not 10.0.256.7, "
            "ssn 123-45-6789, call +1 (555) 123-4567 or +1 555 123 4567 end")
    new, spans = pii.replace(f, text)
    got = [(k, new[a:b]) for k, a, b in spans]
    assert [k for k, _ in got] == ["email", "email", "card", "card", "iban", "date", "date", "ip", "ssn", "phone", "phone"]
    value = [v for _, v in got]
    assert value[0] == value[1] and value[2].replace(" ", "") == value[3] and value[2][4] == " "
    assert pii.luhn_digit(value[3][:-1]) == value[3][-1]
    plain = value[4].replace(" ", "")
    assert pii.iban_digits(plain[4:], plain[:2]) == plain[2:4] and len(value[4]) == 27
    assert value[5].split("-") == value[6].split(".")[::-1]
    assert value[9][:5] == "+1 (" + value[9][4] and [c for c in value[9] if c.isdigit()] == [c for c in value[10] if c.isdigit()]
    for old in ("4111", "ann.lee", "3704", "1987-02-28", "28.02.1987", "10.0.255.7", "123-45-6789", "123-4567"):
        assert old not in new.replace("4111111111111112", "")
    assert "4111111111111112" in new and "1987-02-30" in new and "10.0.256.7" in new
    assert pii.replace(f, text) == (new, spans) and pii.replace(pii.Feistel("z"), text)[0] != new


def test_pseudonyms_never_collide():
    f = pii.Feistel("k")
    cards = {(b := f"4{n:014d}") + pii.luhn_digit(b) for n in range(300)}
    assert len({pii.replace(f, c)[0] for c in cards}) == 300
    assert len({pii.replace(f, f"user{n}@mail.example.com")[0] for n in range(300)}) == 300


def test_pii_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'old' AS pii_spans")
    rows = pii.pseudonymise(docs, "k").collect()
    assert sorted(str(r[:5]) for r in rows) == sorted(str(r[:5]) for r in odd_docs.collect()) and all(r.pii_spans == [] for r in rows)
    assert pii.pseudonymise(no_docs, "k").count() == 0
    hit = spark.createDataFrame([(1, "a@b.example"), (2, "a@b.example"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(hit, "k").collect()}
    assert rows[1].text == rows[2].text != "a@b.example" and rows[1].pii_spans[0].kind == "email" and rows[3].text is None


def test_quoted_secrets_are_replaced():
    f = pii.Feistel("k")
    new, spans = pii.replace(f, 'a token = "24be64439e3e49cf" b api_key: \'ABCdef123456\' c token = "short"')
    assert [k for k, _, _ in spans] == ["secret", "secret"] and "24be6443" not in new and "ABCdef" not in new
    assert new.startswith('a token = "') and new.endswith('c token = "short"') and len(new) == 72


@pytest.mark.parametrize("text, kind, value", [
    ("pay 4111 1111 1111 1111 12/27 now", "card", "4111 1111 1111 1111"), ("4111111111111111 123", "card", "4111111111111111"),
    ("no. 12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"), ("DE89370400440532013000 EUR 500", "iban", "DE89370400440532013000"),
    ("DE89 3704 0044 0532 0130 00 I paid", "iban", "DE89 3704 0044 0532 0130 00"), ("to MT84MALT011000012345MTLCAST001S.", "iban", "MT84MALT011000012345MTLCAST001S"),
    ("AB12 DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"), ("TR33 0006 1005 1978 6457 8413 26", "iban", "TR33 0006 1005 1978 6457 8413 26"),
    ("call +1 555 123 4567 1111 2222 now", "phone", "+1 555 123 4567 1111")])
def test_values_that_more_digits_or_capitals_follow(text, kind, value):
    f = pii.Feistel("k")
    new, spans = pii.replace(f, text)
    [(got, a, b)] = spans
    at = text.index(value)
    assert got == kind and a == at and b == at + len(value) and new[a:b] != value
    assert new[:a] == text[:at] and new[b:] == text[at + len(value):]


def test_secrets_of_any_case_and_length():
    f = pii.Feistel("k")
    long = "aB3" * 5000
    new, spans = pii.replace(f, f'TOKEN = "9233A8BC01" and Api_Key: \'{long}\' and my_PASSWORD="hunter2hunter2"')
    assert [k for k, _, _ in spans] == ["secret"] * 3 and "9233A8BC01" not in new and long[:300] not in new and "hunter2" not in new
    pieces = {new[spans[1][1]:spans[1][2]][k:k + pii.PIECE] for k in range(20, 14000, 600)}
    assert len(pieces) == len(range(20, 14000, 600))
    assert pii.replace(f, "u" * 9000 + "@example.com")[1][0][0] == "email"


def test_capitals_count_alike_in_long_texts():
    at = toxicity.FEATURES.index("capitals")
    assert toxicity.features("ЖУК " * 5000)[at] == toxicity.features("ЖУК " * 50)[at] == 0.75
