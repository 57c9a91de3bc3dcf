"""Line folds over dense pages, extraction over the dictionary of texts."""

import random
import time

from expirylens.operators import lines
from expirylens.operators.candidates import extract_candidates, token_candidates
from expirylens.operators.lines import reconstruct_lines
from expirylens.plans import fixtures as X
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
TOKENS = "image_id string, token_index int, text string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def page(n, image, height, seed, tall=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(0, 2000), round(r.uniform(0, height), r.randint(0, 3))
        h = r.uniform(200, 900) if r.random() < tall else r.uniform(0.2, 14)
        out.append((image, i, f"t{i}" if r.random() > 0.01 else " ", 0.5, None if r.random() < 0.01 else (x, y, x + r.uniform(5, 60), y + h)))
    return out


def plain_lines(tokens, tolerance=0.6):
    """The fold as it is told, over all rows."""
    boxed = sorted((((b[1] + b[3]) / 2, b[0], i, max(1.0, b[3] - b[1]), t.strip()) for _, i, t, _, b in tokens if b), key=lambda x: x[:3])
    rows = []
    for cy, left, i, h, text in boxed:
        for row in rows:
            if abs(cy - row[0] / row[1]) <= tolerance * max(h, row[2]):
                row[0], row[1], row[2] = row[0] + cy, row[1] + 1, max(row[2], h)
                row[3].append((left, cy, i, text))
                break
        else:
            rows.append([cy, 1, h, [(left, cy, i, text)]])
    out = [[(i, text) for _, _, i, text in sorted(row[3])] for row in rows] + [[(i, t.strip()) for _, i, t, _, b in tokens if not b]]
    return [(" ".join(t for _, t in row if t), [i for i, _ in row]) for row in out if any(t for _, t in row)]


def test_dense_pages_fold_as_told(spark):
    pages = {"dense": page(3000, "dense", 900, 1), "loose": page(2500, "loose", 40000, 2), "tall": page(1200, "tall", 3000, 3, 0.02),
             "small": page(30, "small", 60, 4), "level": [("level", i, f"x{i}", 0.5, (float(i % 7), 5.0, 9.0, 9.0)) for i in range(600)]}
    df = spark.createDataFrame([t for p in pages.values() for t in p], TOKENS)
    got = {}
    for r in reconstruct_lines(df).orderBy("image_id", "line_ordinal").collect():
        got.setdefault(r.image_id, []).append((r.text, list(r.token_indices)))
    assert got == {k: plain_lines(p) for k, p in pages.items()}


def test_a_page_of_20000_tokens_takes_linear_time(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAX_TOKENS_IN_ONE_FOLD", 10**9)  # one fold, no cut
    times = []
    for n in (5000, 5000, 20000):
        data = page(n, "p", n / 4, 7)
        df = spark.createDataFrame(data, TOKENS).cache()
        df.count()
        start = time.time()
        got = [r.text for r in reconstruct_lines(df).orderBy("line_ordinal").collect()]
        times.append(time.time() - start)
        assert got == [t for t, _ in plain_lines(data)]
    assert times[2] < 8 * max(times[1], 1.0)


def test_dictionary_gives_the_same_candidates(spark):
    t = X.tokens(spark, SF)
    one = spark.createDataFrame([("img_odd", i, x, 0.5) for i, x in enumerate([" 2021.02.03 ", "2021.02.03", None, "", "O1/02/2021", "no date", "2021.02.03"])],
                                "image_id string, token_index int, text string, confidence double")
    t = t.unionByName(one, allowMissingColumns=True)
    for flags in ((False, False), (True, True)):
        a, b = token_candidates(t, *flags), token_candidates(t, *flags, by_text=True)
        assert a.count() > 1000 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert extract_candidates(t, True, True).exceptAll(extract_candidates(t, True, True, by_text=True)).isEmpty()


def test_the_grammar_stands_once_in_the_dictionary(spark):
    t = X.tokens(spark, SF)
    narrow, by_text = plan(token_candidates(t, True, True)), plan(token_candidates(t, True, True, by_text=True))
    assert "Python" not in by_text and "CartesianProduct" not in by_text and "NestedLoop" not in by_text
    assert by_text.count("regexp_replace(t") == narrow.count("regexp_replace(t")
