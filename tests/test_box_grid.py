"""Overlaps over grids against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from expirylens.operators import box_grid as G, boxes as B, selection as S

TOKENS = "image_id string, token_index int, text string, bbox struct<x1:double,y1:double,x2:double,y2:double>"
BOXES = "image_id string, box_index int, class int, bbox struct<x1:double,y1:double,x2:double,y2:double>"


def iou(a, b):
    """Table of overlaps of two arrays of boxes."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    return inter / np.maximum(1e-9, area(a)[:, None] + area(b)[None, :] - inter)


def some_boxes(rng, n):
    """Mostly small boxes, some of the whole page, points, inside-out ones, some far outside, some on one spot."""
    at = rng.uniform(0, 1000, (n, 2))
    size = rng.choice([1, 8, 8, 8, 60, 900], (n, 1)) * rng.uniform(0.5, 1.5, (n, 2))
    out = np.hstack([at, at + size])
    out[::41, 2:] = out[::41, :2]
    out[1::43] = out[1::43][:, [2, 3, 0, 1]]
    out[2::47] += 5000
    out[3::23] = [10, 10, 30, 25]
    return np.round(out, 3)


@pytest.fixture(params=[64, 3])
def per_cell(request, monkeypatch):
    monkeypatch.setattr(G, "BOXES_PER_CELL", request.param)


def test_overlap_equals_all_pairs(spark, per_cell, monkeypatch):
    monkeypatch.setattr(B, "BOXES_PER_BLOCK", 50)
    rng = np.random.default_rng(5)
    t, b = {}, {}
    for image, n, m in (("a", 700, 900), ("b", 5, 2), ("c", 30, 65), ("d", 4, 0), ("e", 0, 80)):
        t[image], b[image] = some_boxes(rng, n), some_boxes(rng, m)
    tokens = spark.createDataFrame([(i, k, "x", tuple(map(float, x))) for i, v in t.items() for k, x in enumerate(v)] + [("a", 9999, "x", None)], TOKENS)
    boxes = spark.createDataFrame([(i, k, k % 3 or None, tuple(map(float, x))) for i, v in b.items() for k, x in enumerate(v)] + [("a", 9999, 7, None)], BOXES)
    boxes = boxes.withColumn("class", F.when(F.col("class") == 2, 0).otherwise(F.col("class")))
    got = {(r.image_id, r.token_index): (r.iou, r.date_iou) for r in B.token_box_overlap(tokens, boxes).collect()}
    kinds = {(r.image_id, r.token_index, r["class"]): r.iou for r in B.overlap_by_class(tokens, boxes).collect()}
    want, want_kinds = {}, {}
    for image in t:
        if not len(b[image]):
            continue
        table, kind = iou(t[image], b[image]), np.arange(len(b[image])) % 3
        for k, row in enumerate(table):
            want[image, k] = (row.max(), row[kind == 2].max(initial=0))
            for code, name in ((0, None), (1, 1), (2, 0)):
                if (kind == code).any():
                    want_kinds[image, k, name] = row[kind == code].max()
    assert got.keys() == want.keys() and kinds.keys() == want_kinds.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    assert all(kinds[k] == pytest.approx(v, abs=1e-12) for k, v in want_kinds.items())


def test_other_source_equals_all_pairs(spark, per_cell):
    rng = np.random.default_rng(6)
    at = some_boxes(rng, 500)
    rows = [("a", k << 20, ["yolo" if k % 2 else None], tuple(map(float, x)) if k % 50 else None) for k, x in enumerate(at)]
    c = spark.createDataFrame(rows, "image_id string, cand_ordinal long, sources array<string>, union_box struct<x1:double,y1:double,x2:double,y2:double>")
    got = {r.cand_ordinal >> 20: r.spatial for r in S.other_source_iou(c).collect()}
    table = iou(at, at)
    here = np.arange(500) % 50 != 0
    for k in range(500):
        other = here & (np.arange(500) % 2 != k % 2)
        assert got[k] == pytest.approx(table[k][other].max() if k % 50 else 0.0, abs=1e-12)


def test_work_grows_with_overlaps_not_with_pairs(spark):
    """20 000 tokens and boxes on one page: under a hundredth of all pairs are looked at."""
    n = 20_000
    place = lambda step: F.struct(*[(v + d).cast("double").alias(name) for name, v, d in (
        ("x1", F.col("id") % 100 * 10 + step, 0), ("y1", F.floor(F.col("id") / 100) * 10, 0),
        ("x2", F.col("id") % 100 * 10 + step, 8), ("y2", F.floor(F.col("id") / 100) * 10, 8))])
    base = spark.range(n)
    t = base.select(F.lit("p").alias("image_id"), F.col("id").cast("int").alias("token_index"), F.lit("x").alias("text"), place(1).alias("bbox"))
    b = base.select(F.lit("p").alias("image_id"), F.col("id").cast("int").alias("box_index"), F.lit(0).alias("class"), place(0).alias("bbox"))
    met = G.meet_boxes(t.withColumn("tile", F.floor(F.col("token_index") / 4096).cast("int")), b, ["image_id"], "tile", F.lit(0), ("bbox",))
    assert met.select(F.sum(F.size("boxes"))).first()[0] < n * n / 100
    r = B.token_box_overlap(t, b).agg(F.count("*"), F.round(F.min("iou"), 9), F.round(F.max("iou"), 9)).first()
    assert tuple(r) == (n, round(56 / 72, 9), round(56 / 72, 9))
