"""Box arithmetic as plain column expressions. A box is struct<x1,y1,x2,y2>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def make_box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
                    x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def box_from_array(a: Column) -> Column:
    return F.when(F.size(a) >= 4, make_box(F.get(a, F.lit(0)), F.get(a, F.lit(1)),
                                           F.get(a, F.lit(2)), F.get(a, F.lit(3))))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when a box is missing."""
    inter = (F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
             * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)))
    area_a = F.greatest(F.lit(0.0), a.x2 - a.x1) * F.greatest(F.lit(0.0), a.y2 - a.y1)
    area_b = F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)
    iou = inter / F.greatest(F.lit(1e-9), area_a + area_b - inter)
    return F.when(a.isNotNull() & b.isNotNull(), iou).otherwise(F.lit(0.0))


def spatial_relation(keyword: Column, cand: Column, same_line_bonus: float = 0.15) -> Column:
    """How well a keyword box introduces a candidate box: near, same row, to the left or above."""
    kx, ky = (keyword.x1 + keyword.x2) / 2.0, (keyword.y1 + keyword.y2) / 2.0
    cx, cy = (cand.x1 + cand.x2) / 2.0, (cand.y1 + cand.y2) / 2.0
    k_h = F.greatest(F.lit(1.0), keyword.y2 - keyword.y1)
    c_h = F.greatest(F.lit(1.0), cand.y2 - cand.y1)
    same_line = F.abs(ky - cy) <= F.greatest(k_h, c_h)
    extent = F.greatest(F.lit(1.0), cand.x2, cand.y2, keyword.x2, keyword.y2)
    near = 1.0 / (1.0 + 4.0 * (F.hypot(kx - cx, ky - cy) / extent))
    bonus = (F.when(same_line & (cx >= kx), F.lit(same_line_bonus))
             .when(cy >= ky, F.lit(same_line_bonus * 0.75)).otherwise(F.lit(0.0)))
    return (F.when(keyword.isNotNull() & cand.isNotNull(), F.least(F.lit(1.5), near + bonus))
            .otherwise(F.lit(0.0)))


def union_boxes(boxes: Column) -> Column:
    """Smallest box around an array of boxes; null entries are ignored, null when none is left."""
    real = F.filter(boxes, lambda b: b.isNotNull())
    return F.when(F.size(real) > 0, F.struct(
        F.array_min(F.transform(real, lambda b: b.x1)).alias("x1"),
        F.array_min(F.transform(real, lambda b: b.y1)).alias("y1"),
        F.array_max(F.transform(real, lambda b: b.x2)).alias("x2"),
        F.array_max(F.transform(real, lambda b: b.y2)).alias("y2")))


def union_box_agg(box: Column) -> Column:
    """The same as an aggregate over rows."""
    return F.when(F.count(box) > 0, F.struct(
        F.min(box.x1).alias("x1"), F.min(box.y1).alias("y1"),
        F.max(box.x2).alias("x2"), F.max(box.y2).alias("y2")))


def polygon_to_bbox(polygon: Column) -> Column:
    """Bounding box of an array of [x, y] points; null for a missing or empty polygon."""
    xs = F.transform(polygon, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(polygon) > 0, make_box(F.array_min(xs), F.array_min(ys),
                                                F.array_max(xs), F.array_max(ys)))


def box_center_size(box: Column) -> Column:
    return F.struct(((box.x1 + box.x2) / 2.0).alias("center_x"),
                    ((box.y1 + box.y2) / 2.0).alias("center_y"),
                    (box.x2 - box.x1).alias("width"), (box.y2 - box.y1).alias("height"))


def aspect_ratio(box: Column) -> Column:
    return F.when(box.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(1.0), box.x2 - box.x1) / F.greatest(F.lit(1.0), box.y2 - box.y1))


def relative_to_pixels(cx, cy, width, height, image_width, image_height) -> Column:
    return make_box((cx - width / 2) * image_width, (cy - height / 2) * image_height,
                    (cx + width / 2) * image_width, (cy + height / 2) * image_height)


def crop_rect(box: Column, image_width, image_height, expand: float = 1.0, margin: int = 0) -> Column:
    """Grow a pixel box around its centre, cut to whole pixels, widen by a margin and clamp.

    The integer cut truncates toward zero before the margin is applied. Null when nothing is left.
    """
    if expand == 1.0:
        left, top, right, bottom = box.x1, box.y1, box.x2, box.y2
    else:
        cx, cy = (box.x1 + box.x2) / 2.0, (box.y1 + box.y2) / 2.0
        w, h = (box.x2 - box.x1) * expand, (box.y2 - box.y1) * expand
        left, top, right, bottom = cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0
    l = F.greatest(F.lit(0), left.cast("int") - margin)
    t = F.greatest(F.lit(0), top.cast("int") - margin)
    r = F.least(image_width.cast("int"), right.cast("int") + margin)
    b = F.least(image_height.cast("int"), bottom.cast("int") + margin)
    return F.when((r > l) & (b > t), F.struct(l.alias("left"), t.alias("top"),
                                              r.alias("right"), b.alias("bottom")))
