import zlib

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression

from expirylens.llm import toxicity


def pooled(x, y):
    """Isotonic fit of y on x by pooling adjacent violators: the fitted value at each different x, sorted."""
    places = sorted(set(x))
    blocks = []
    for p in places:
        own = [b for a, b in zip(x, y, strict=True) if a == p]
        blocks.append([sum(own), len(own), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, ps = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += ps
    return {p: s / n for s, n, ps in blocks for p in ps}


def test_calibration_is_pooling_with_a_mean_row_at_either_end(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random(60), 2).tolist()
    y = [float(rng.random() < v) for v in x]
    rows = toxicity.calibration_rows(spark.createDataFrame(list(zip(x, y, strict=True)), "margin double, label double"), 0.3)
    got = sorted((r.margin, r.label) for r in rows.collect())
    assert got == sorted([*zip(x, y, strict=True), (min(x), 0.3), (max(x), 0.3)])
    model = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(rows)
    want = pooled([a for a, _ in got], [b for _, b in got])
    assert {r.margin: pytest.approx(r.score) for r in model.transform(rows).collect()} == want


def test_first_split_is_the_best_one(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((80, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.random(80) > 0.7).astype(float)
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)], "list array<double>, label double").select(array_to_vector("list").alias("x"), "label")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=1, maxDepth=1, maxBins=48, seed=1).fit(df)
    best = min(((y[x[:, f] <= c].var() * (x[:, f] <= c).sum() + y[x[:, f] > c].var() * (x[:, f] > c).sum()), f, c)
               for f in range(3) for c in sorted(set(x[:, f]))[:-1])
    left = {tuple(r.v): r.prediction for r in model.transform(df).select(vector_to_array("x").alias("v"), "prediction").collect()}
    low, high = y[x[:, best[1]] <= best[2]].mean(), y[x[:, best[1]] > best[2]].mean()
    assert low < 0.5 < high and all((v[best[1]] > best[2]) == bool(p) for v, p in left.items())


def few(spark, positives, clean, unlabelled=150):
    """Documents of which some are labelled, with plain abuse in the toxic ones."""
    rng = np.random.default_rng(positives)
    words = ["garden", "window", "paper", "cloud", "bread", "river", "stone", "letter"]
    learn = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5]
    docs, labels = [], []
    for k, i in enumerate(learn[:positives + clean + unlabelled]):
        text = list(rng.choice(words, int(rng.integers(20, 60))))
        if k < positives:
            text[3:3] = ["you", "idiot", "moron", "pathetic"]
        docs.append((i, " ".join(text)))
        if k < positives + clean:
            labels.append((i, int(k < positives)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), set(learn[:positives])


def test_ten_positive_labels(spark):
    docs, labels, bad = few(spark, 10, 60)
    rows = toxicity.score(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.predicted} == bad
    assert max(r.score for r in rows) < 1 and min(r.score for r in rows) > 0


@pytest.mark.parametrize("positives,clean", [(2, 40), (5, 3)])
def test_few_labels_of_one_class_stay_near_the_mean(spark, positives, clean):
    docs, labels, bad = few(spark, positives, clean, 40)
    rows = toxicity.score(docs, labels, trees=3).collect()
    mean = positives / (positives + clean)
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    if mean < 0.5:
        assert sum(r.predicted for r in rows) <= positives
