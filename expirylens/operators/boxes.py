"""Joins between tokens, candidates, region boxes and archives, and weak labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.functions.dates import final_date_sql, normalized_options
from expirylens.functions.geometry import box_iou, crop_rect, make_box
from expirylens.functions.text import is_full_date
from expirylens.operators.box_grid import meet_boxes
from expirylens.operators.ordering import in_one_tile, join_by_tile, top_per_group
from expirylens.operators.selection import candidate_tile
from expirylens.plans.storage import materialise
from expirylens.schemas import tile_of

BOXES_PER_BLOCK = 256


def pixel_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Relative centre boxes to pixel corner boxes in column ``bbox``."""
    c = F.col
    return boxes.withColumn("bbox", make_box(
        (c("cx") - c("width") / 2) * width, (c("cy") - c("height") / 2) * height,
        (c("cx") + c("width") / 2) * width, (c("cy") + c("height") / 2) * height))


def boxes_by_kind(boxes: DataFrame) -> DataFrame:
    """Date boxes (class 0) and boxes of other classes of an image, each in arrays of at most BOXES_PER_BLOCK in box order."""
    box = F.struct("box_index", "bbox")
    return (boxes.groupBy("image_id", F.floor(F.col("box_index") / BOXES_PER_BLOCK).alias("block"))
            .agg(F.array_sort(F.collect_list(F.when(F.col("class") == 0, box))).alias("dates"),
                 F.array_sort(F.collect_list(F.when(F.col("class") != 0, box))).alias("others")))


def token_box_overlap(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per token with a box: best IoU with any region box, and with a date (class 0) box.

    A token meets arrays of the boxes in its cells, so tokens and boxes are never paired as rows.
    """
    t = tokens.filter(F.col("bbox").isNotNull()).select("image_id", "token_index", "text", "bbox",
                                                        tile_of(F.col("token_index")).alias("tile"))
    best = lambda arr: F.array_max(F.transform(arr, lambda b: box_iou(F.col("bbox"), b.bbox)))
    j = meet_boxes(t, boxes, ["image_id"], "tile", F.floor(F.col("box_index") / BOXES_PER_BLOCK), ("class", "bbox"))
    return (j.select("image_id", "tile", "token_index", "text", best(F.col("boxes")).alias("a"),
                     best(F.filter("boxes", lambda b: b["class"] == 0)).alias("d"))
            .groupBy("image_id", "tile", "token_index", "text")
            .agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("iou"), F.coalesce(F.max("d"), F.lit(0.0)).alias("date_iou"))
            .drop("tile"))


def overlap_by_class(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per token and class of the image's boxes: best IoU, 0 where none overlaps. Boxes without a place do not count."""
    t = tokens.filter(F.col("bbox").isNotNull()).select("image_id", "token_index", "bbox",
                                                        tile_of(F.col("token_index")).alias("tile"))
    # the class as a struct, as boxes of no class are a kind too
    b = boxes.filter(F.col("bbox").isNotNull()).select("image_id", F.struct("class").alias("kind"), "box_index", "bbox")
    every = join_by_tile(t, b.select("image_id", "kind").distinct(), "image_id", "tile", single=in_one_tile(t, "tile"))
    j = meet_boxes(every, b, ["image_id", "kind"], "tile", F.floor(F.col("box_index") / BOXES_PER_BLOCK), ("bbox",))
    best = F.array_max(F.transform("boxes", lambda x: box_iou(F.col("bbox"), x.bbox)))
    return (j.select("image_id", "tile", "token_index", "kind", best.alias("i")).groupBy("image_id", "tile", "token_index", "kind")
            .agg(F.coalesce(F.max("i"), F.lit(0.0)).alias("iou")).select("image_id", "token_index", "kind.class", "iou"))


def _with_target(labels: DataFrame) -> DataFrame:
    return labels.select("image_id", F.col("final_date").alias("label"), F.expr(final_date_sql("final_date")).alias("target"))


def _key(c: str = "") -> Column:
    return F.when(F.col("calendar_valid"), F.struct("year", "month", "day"))


def align_boxes_to_candidates(images: DataFrame, labels: DataFrame, tokens: DataFrame, scored: DataFrame,
                              boxes: DataFrame) -> DataFrame:
    """Per image the date box that a label-matching candidate overlaps best, trimmed, or why not.

    Candidates meet arrays of date boxes; the winner is kept by (IoU, score). Boxes of other
    classes that overlap at least a quarter horizontally then cut the winner, in box order. Candidates and
    boxes are read once: the few that match and the arrays of each image are stored.
    """
    has_tokens = tokens.select("image_id").distinct().withColumn("has_tokens", F.lit(True))
    target = _with_target(labels)
    base = images.select("image_id").join(target, "image_id", "left").join(has_tokens, "image_id", "left")
    match = materialise(scored.withColumn("k", _key()).join(target.filter("target IS NOT NULL").select("image_id", "target"), "image_id")
                        .filter(F.col("k") == F.col("target"))
                        .select("image_id", "cand_ordinal", "score", "union_box", "raw_text"))
    any_match = match.groupBy("image_id").agg(F.max(F.col("union_box").isNotNull()).alias("has_box"))
    blocks = materialise(boxes_by_kind(boxes))
    date_boxes = blocks.filter(F.size("dates") > 0).select("image_id", F.col("dates").alias("boxes"))
    has_date = date_boxes.select("image_id").distinct().withColumn("has_date_box", F.lit(True))
    placed = match.filter("union_box IS NOT NULL").withColumn("tile", candidate_tile(F.col("cand_ordinal")))
    pairs = join_by_tile(placed, date_boxes, "image_id", "tile", single=in_one_tile(placed, "tile"))
    rated = F.transform("boxes", lambda b: F.struct(box_iou(F.col("union_box"), b.bbox).alias("iou"),
                                                    (-b.box_index).alias("o"), b.bbox.alias("bbox")))
    best = (pairs.withColumn("b", F.array_max(rated)))
    best = top_per_group(best, ["image_id"], [F.desc("b.iou"), F.desc("score"), F.asc("cand_ordinal"), F.desc("b.o")]).select(
        "image_id", F.col("b.iou").alias("overlap"), F.col("b.bbox").alias("box"), "raw_text", "score")
    others = (blocks.filter(F.size("others") > 0).groupBy("image_id").agg(
        F.array_sort(F.flatten(F.collect_list("others"))).alias("others")))
    j = best.join(others, "image_id", "left")
    start = F.struct(F.col("box.y1").alias("top"), F.col("box.y2").alias("bottom"))
    left, right = F.col("box.x1"), F.col("box.x2")

    def cut(a: Column, o: Column) -> Column:
        b = o.bbox
        wide = F.greatest(F.lit(0.0), F.least(right, b.x2) - F.greatest(left, b.x1)) >= 0.25 * F.greatest(
            F.lit(1.0), F.least(right - left, b.x2 - b.x1))
        below = wide & (b.y1 >= a.top) & (b.y1 < a.bottom) & (b.y2 > a.top)
        above = wide & ~below & (b.y2 <= a.bottom) & (b.y2 > a.top) & (b.y1 < a.top)
        return F.struct(F.when(above, F.greatest(a.top, b.y2 + 1.0)).otherwise(a.top).alias("top"),
                        F.when(below, F.least(a.bottom, b.y1 - 1.0)).otherwise(a.bottom).alias("bottom"))
    trimmed = F.aggregate(F.coalesce("others", F.array().cast("array<struct<box_index:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>")),
                          start, cut)
    j = j.withColumn("t", trimmed).select("image_id", "overlap", "score", "raw_text", make_box(
        left, F.col("t.top"), right, F.col("t.bottom")).alias("crop_box"))
    out = (base.join(any_match, "image_id", "left").join(has_date, "image_id", "left").join(j, "image_id", "left"))
    c = F.col
    status = (F.when(c("target").isNull() | c("has_tokens").isNull(), "missing_label_or_tokens")
              .when(c("has_box").isNull(), "no_matching_ocr_candidate")
              .when(c("has_date_box").isNull(), "no_gt_date_box")
              .when(~c("has_box"), "candidate_without_bbox")
              .when((c("crop_box.x2") <= c("crop_box.x1")) | (c("crop_box.y2") <= c("crop_box.y1") + 3), "trimmed_box_empty")
              .otherwise("ok"))
    return out.select("image_id", status.alias("status"), "label", *[
        F.when(status == "ok", c(n)).alias(n) for n in ("overlap", "crop_box", "raw_text")])


def weak_label_matches(scored: DataFrame, labels: DataFrame, image_width: Column, image_height: Column,
                       margin: int = 6) -> DataFrame:
    """Best-ranked candidate that equals the label, with its padded box; images without one drop out."""
    hit = (scored.withColumn("k", _key()).join(_with_target(labels), "image_id").filter(F.col("k") == F.col("target")))
    best = top_per_group(hit, ["image_id"], [F.desc("score"), F.asc("cand_ordinal")])
    rect = F.when(F.col("union_box").isNotNull(), crop_rect(F.col("union_box"), image_width, image_height, margin=margin))
    return best.filter(F.col("union_box").isNotNull()).select("image_id", "label", "raw_text", rect.alias("rect"))


def match_by_checksum(local: DataFrame, archive: DataFrame, labels: DataFrame) -> DataFrame:
    """Local images (image_id, crc) to archive rows (name, crc) by content, then to label rows (name).

    Status ok, no_kaggle_image_match or no_label. A checksum occurring several times in the
    archive keeps its last name; both sides are reduced per checksum before they meet.
    """
    a = archive.filter(F.col("name").contains("/images/")).groupBy("crc").agg(F.max("name").alias("archive_image"))
    j = local.join(a, "crc", "left").withColumn("label_name", F.concat(F.regexp_replace(
        F.replace("archive_image", F.lit("/images/"), F.lit("/labels/")), r"\.[^./]*$", ""), F.lit(".txt")))
    lab = labels.select(F.col("name").alias("label_name")).distinct().withColumn("has_label", F.lit(True))
    j = j.join(lab, "label_name", "left")
    status = (F.when(F.col("archive_image").isNull(), "no_kaggle_image_match")
              .when(F.col("has_label").isNull(), "no_label").otherwise("ok"))
    return j.select("image_id", "crc", "archive_image", F.when(status == "ok", F.col("label_name")).alias("label_name"),
                    status.alias("status"))


def identity_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two stores (name, crc): same name, renamed but same content, unmatched on each side."""
    j = left.select("name", F.col("crc").alias("l")).join(right.select("name", F.col("crc").alias("r")), "name", "full")
    same = j.filter("l IS NOT NULL AND r IS NOT NULL").agg(
        F.count("*").alias("same_name"), F.coalesce(F.sum(F.when(F.col("l") == F.col("r"), 1).otherwise(0)), F.lit(0)).alias("same_name_same_content"))
    # content that is left over on either side, reduced to counts per checksum before it meets
    count = lambda cond, c, n: j.filter(cond).groupBy(F.col(c).alias("crc")).agg(F.count("*").alias(n))
    rest = count("r IS NULL", "l", "nl").join(count("l IS NULL", "r", "nr"), "crc", "full")
    s = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(0)), F.lit(0))
    both = F.col("nl").isNotNull() & F.col("nr").isNotNull()
    return same.crossJoin(F.broadcast(rest.agg(                       # one row on each side
        s(both, "nl").alias("renamed_same_content"), s(F.col("nr").isNull(), "nl").alias("unmatched_left"),
        s(F.col("nl").isNull(), "nr").alias("unmatched_right"))))


def split_assignment(items: DataFrame, splits: DataFrame, include_test: bool = False) -> DataFrame:
    """Attach train/val/test by id (the last split wins for an id listed twice); drop unassigned ids."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("train", "val", "test")]), F.col("split"))
    one = splits.groupBy("image_id").agg(F.max_by("split", order).alias("split"))
    out = items.join(one, "image_id")
    return out if include_test else out.filter("split <> 'test'")


def boxes_by_split(box_rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Box rows restricted to the ids of each split."""
    return box_rows.join(splits.select("image_id", "split").distinct(), "image_id")


def teacher_agreement(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """Crops whose recognised text can be read as the label; the best per image by (score, due)."""
    lab = labels.filter(is_full_date(F.col("final_date"))).select("image_id", F.col("final_date").alias("label"))
    # each different text is read once; the readings are explode's output, so that no filter evaluates them again
    known = crops.select("raw").filter("raw IS NOT NULL").distinct().select("raw", F.explode(F.array(normalized_options(F.col("raw")))).alias("__read"))
    ok = crops.join(lab, "image_id").join(known, "raw").filter(F.array_contains("__read", F.col("label"))).select(*crops.columns, "label")
    return top_per_group(ok, ["image_id"], [F.desc("rec_score"), F.desc(F.col("class") == 1), F.asc("candidate_index")]).drop("rank")


def teacher_agreement_rate(best: DataFrame, labels: DataFrame, images: DataFrame) -> DataFrame:
    full = labels.filter(is_full_date(F.col("final_date"))).select("image_id")
    eligible = images.select("image_id").join(full, "image_id", "left_semi").agg(F.count("*").alias("eligible_images"))
    return best.agg(F.count("*").alias("agreement_images")).crossJoin(F.broadcast(eligible)).withColumn(
        "agreement_rate", F.col("agreement_images") / F.greatest(F.lit(1), "eligible_images"))


def pseudo_labels(best: DataFrame, predictions: DataFrame, min_confidence: float = 0.85) -> DataFrame:
    """High-confidence predictions as labels, with the rule that admitted them.

    ``best`` is the top-ranked candidate per image.
    """
    keep = best.filter(F.col("calendar_valid") & F.col("year").isNotNull() & F.col("day").isNotNull()
                       & (F.col("recognition_confidence") >= min_confidence)).select(
        "image_id", "raw_text", "recognition_confidence", "positive_keyword", F.col("evidence").alias("why"))
    rule = F.when(F.col("positive_keyword") > 0, "high_conf_keyword").otherwise("high_conf_direct_stamp")
    return (predictions.filter("final_date <> 'NONE'").join(keep, "image_id").select(
        "image_id", "year", "month", "day", "final_date", F.format_string("%.4f", "recognition_confidence").alias("confidence"),
        rule.alias("rule"), "raw_text", F.format_string("%.4f", "positive_keyword").alias("positive_keyword_score"),
        F.array_join("why", "|").alias("evidence")))


def pseudo_label_agreement(pseudo: DataFrame, existing: DataFrame) -> DataFrame:
    j = pseudo.select("image_id", "final_date").join(
        existing.select("image_id", F.col("final_date").alias("existing")), "image_id")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    # equal NONEs cannot occur: pseudo labels are never NONE
    matched, total = n(F.col("final_date") == F.col("existing")), n(F.col("existing") != "NONE")
    return j.agg(matched.alias("matched"), total.alias("with_truth"),
                 F.when(total > 0, matched / total * 100).otherwise(0.0).alias("agreement_pct"))


def low_confidence_images(tokens: DataFrame, images: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Images without tokens or with a mean confidence (to 12 decimals, summed exactly) below the threshold."""
    # exact sums, as the order of doubles would decide on means that equal the threshold; numbers no decimal holds are left to the mean
    exact = F.col("confidence").try_cast("decimal(24,12)")
    low = F.when(F.count(exact) == F.count("confidence"), F.sum(exact) < F.lit(threshold).cast("decimal(24,12)") * F.count(exact)).otherwise(
        F.avg("confidence") < threshold)
    mean = tokens.groupBy("image_id").agg(F.avg("confidence").alias("mean_confidence"), low.alias("__low"))
    return images.select("image_id").join(mean, "image_id", "left").filter(
        F.col("mean_confidence").isNull() | F.col("__low")).drop("__low")


def candidate_miss_breakdown(rows: DataFrame, detector: DataFrame) -> DataFrame:
    """Images without the right candidate by detector outcome: no box, no date text, other date only."""
    d = detector.groupBy("image_id").agg(F.max(F.col("prediction").isNotNull()).alias("has_date"))
    reason = (F.when(F.col("has_date").isNull(), "no_detector_box")
              .when(~F.col("has_date"), "box_without_date_text").otherwise("other_date_only"))
    return (rows.filter(F.col("target_key").isNotNull() & ~F.col("covered")).join(d, "image_id", "left")
            .groupBy(reason.alias("reason")).agg(F.count("*").alias("images")))


def gt_date_crops(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Union of the class-0 boxes of every image with a trainable label."""
    return (boxes.filter("class = 0").groupBy("image_id").agg(
        F.min("bbox.x1").alias("x1"), F.min("bbox.y1").alias("y1"), F.max("bbox.x2").alias("x2"), F.max("bbox.y2").alias("y2"))
        .join(labels.select("image_id", F.col("final_date").alias("label")), "image_id"))
