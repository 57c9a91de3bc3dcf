import pytest
from pyspark.sql import functions as F

from expirylens import schemas
from expirylens.operators import boxes as B, candidates as C, search as Q, selection as S
from expirylens.plans import catalog, fixtures as X
from expirylens.plans.storage import materialise
from test_round5 import canonical, exchanges

SMALL = "/root/testdata/sf0.001"

IMAGES = {"a": [("2026.01.02", 0.9, (0, 0, 80, 18), "yolo"), ("2025.05.05", 0.8, (0, 0, 80, 18), "baseline"), ("EXP", 0.9, (0, 20, 40, 38), "baseline")],
          "b": [("2024.03.04", 0.6, (0, 0, 80, 18), "yolo"), ("2023.01.01", 0.7, (40, 0, 120, 18), None), ("2026.07.08", 0.2, (300, 0, 380, 18), "yolo")],
          "c": [("2024.", 0.9, (0, 0, 40, 18), "yolo"), ("05.", 0.5, (45, 0, 70, 18), "baseline"), ("06", 0.7, (75, 0, 90, 18), "yolo")],
          "d": [("no date", 0.9, None, "yolo")], "e": [("2022.02.02", 0.9, None, "yolo")]}


def test_alignment_reads_candidates_and_boxes_once(spark, token_table):
    tokens = materialise(token_table(IMAGES))
    labels = spark.createDataFrame([("a", "2026-01-02"), ("b", "2024-03-04"), ("e", "2022-02-02"), ("d", "NONE")], "image_id string, final_date string")
    scored = materialise(S.score_candidates(S.features(C.extract_candidates(tokens), tokens)))
    # date boxes of two blocks; the later one is the better one
    rows = [("a", 0, 0, (50.0, 0.0, 130.0, 18.0)), ("a", 300, 0, (0.0, 0.0, 80.0, 20.0)), ("a", 301, 1, (0.0, 15.0, 80.0, 40.0)),
            ("a", 1, 1, (0.0, -5.0, 80.0, 2.0)), ("b", 0, 1, (0.0, 0.0, 80.0, 18.0)), ("e", 0, 0, (0.0, 0.0, 80.0, 18.0))]
    boxes = materialise(spark.createDataFrame(rows, f"image_id string, box_index int, class int, bbox {schemas.BBOX_DDL}"))
    out = B.align_boxes_to_candidates(labels.select("image_id"), labels, tokens, scored, boxes)
    got = {r.image_id: (r.status, r.crop_box and tuple(r.crop_box)) for r in out.collect()}
    assert got == {"a": ("ok", (0.0, 3.0, 80.0, 14.0)), "b": ("no_gt_date_box", None), "d": ("missing_label_or_tokens", None),
                   "e": ("candidate_without_bbox", None)}
    assert not set(out.inputFiles()) & set(boxes.inputFiles() + scored.inputFiles())


@pytest.mark.parametrize("tile", [4096, 1])
def test_multipliers_share_one_evaluation(spark, token_table, monkeypatch, tile):
    monkeypatch.setattr(schemas, "TILE_TOKENS", tile)
    tokens = materialise(token_table(IMAGES))
    target = {"a": "2026-01-02", "b": "2026-07-08", "c": "2024-05-06", "d": "NONE", "e": "2022-02-03"}
    labels = materialise(spark.createDataFrame(list(target.items()), "image_id string, final_date string"))
    steps = (0.1, 0.5, 1.0)
    out = Q.source_multiplier_sweep(tokens, labels, "yolo", multipliers=steps)
    planned = exchanges(out)
    got = {r.multiplier: (r.final_em, r.candidate_recall, r.selection_accuracy) for r in out.collect()}
    cands = C.extract_candidates(tokens)
    shown = F.concat_ws("-", "year", "month", "day").alias("shown")
    found = {tuple(r) for r in cands.select("image_id", shown).collect()}
    covered = sum((i, d) in found for i, d in target.items())
    for m in steps:
        scaled = tokens.withColumn("confidence", F.col("confidence") * F.when(F.col("source") == "yolo", m).otherwise(1.0))
        best = S.select_best(S.score_candidates(S.features(C.extract_candidates(scaled), scaled)))
        right = sum(target[r.image_id] == r.shown for r in best.select("image_id", shown).collect()) + 1
        assert got[m] == pytest.approx((right / 5, covered / 4, right / covered)), m
    if tile > 1:
        assert planned == exchanges(Q.source_multiplier_sweep(tokens, labels, "yolo", multipliers=steps[:1]))


def test_boxes_of_the_other_source_need_no_shuffle_of_candidates(spark, token_table, monkeypatch):
    crowd = {"f": [("2026.01.02", 0.9, (5 * i, 0, 5 * i + 8, 18), "yolo" if i % 3 else "baseline") for i in range(150)]}
    for images, tile in ((IMAGES, 4096), ({**IMAGES, **crowd}, 4096), (IMAGES, 1)):
        monkeypatch.setattr(schemas, "TILE_TOKENS", tile)
        tokens = token_table(images)
        stored = materialise(C.extract_candidates(tokens))
        scored = materialise(S.score_candidates(S.features(stored, tokens)))
        got = S.other_source_iou(scored, stored)
        assert canonical(got) == canonical(S.other_source_iou(scored).select(got.columns))
    monkeypatch.setattr(schemas, "TILE_TOKENS", 4096)
    tokens = token_table(IMAGES)
    stored = materialise(C.extract_candidates(tokens))
    c = S.score_candidates(S.features(stored, tokens))
    # one more exchange, that of the boxes of an image
    assert exchanges(S.other_source_iou(c, stored)) <= exchanges(c) + 1


def test_normalising_does_not_build_features(spark):
    catalog.load_all()
    X.forget()
    rows = catalog.QUERIES["t8_normalize_prediction"](spark, SMALL).count()
    assert rows >= X.images(spark, SMALL).count()
    assert "features" not in {name for _, _, name in X._stored}
