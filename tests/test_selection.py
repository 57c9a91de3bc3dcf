"""Scoring and selection on small images, and equality of tiled and untiled evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from expirylens import schemas
from expirylens.operators import normalize as N, selection as S
from expirylens.plans.flows import predict, scored_candidates



def best(tokens, params=S.ScoreParams(), union=False):
    scored = scored_candidates(tokens, params, store=lambda df: df)
    picked = S.select_union(scored, None, params) if union else S.select_best(scored)
    return {r.image_id: r for r in picked.collect()}


def test_context_prefers_expiry(token_table):
    t = token_table({
        "ko": [("제조일자", .99, (0, 0, 60, 20)), ("2025.01.01", .99, (70, 0, 150, 20)), ("소비기한", .8, (0, 40, 60, 60)), ("2026.01.01", .8, (70, 40, 150, 60))],
        "en": [("MFD", .99, (0, 0, 40, 20)), ("2025.01.01", .99, (50, 0, 130, 20)), ("EXP DATE", .8, (0, 40, 70, 60)), ("2026.01.01", .8, (80, 40, 160, 60))],
        "time": [("까지", .9, (0, 0, 30, 20)), ("05:16", .99, (40, 0, 80, 20)), ("21.08.06", .99, (90, 0, 160, 20))]})
    got = best(t)
    assert got["ko"].year == "2026" and got["en"].year == "2026"
    assert (got["time"].year, got["time"].month) == ("2021", "08")
    assert "expiry_keyword" in got["ko"].evidence and "later_expiry_date" in got["ko"].evidence


def test_source_multiplier(token_table):
    t = token_table({"a": [("2021.01.01", .99, (0, 0, 100, 20)), ("2026.01.01", .99, (0, 40, 100, 60), "svtr_local_roi")]})
    assert best(t, S.ScoreParams(source_confidence_multipliers={"svtr_local_roi": 0.25}))["a"].year == "2021"
    assert best(t)["a"].year == "2026"


def test_union_prefers_second_source(token_table):
    t = token_table({"a": [("2025.01.01", .99, (0, 0, 100, 20), "baseline"), ("2026.01.01", .9, (0, 0, 100, 20), "yolo", .95)]})
    p = S.UnionParams(keyword_weight=0.0, negative_keyword_weight=0.0, candidate_score_weight=0.0, recognition_log_weight=0.0, detection_log_weight=0.0)
    got = best(t, p, union=True)["a"]
    assert got.year == "2026" and abs(got.spatial - 1.0) < 1e-9


def test_ambiguity_suite(token_table):
    want = {"15FEB22": "2022-02-15", "29.Jan.2024": "2024-01-29", "13/03/22": "2022-03-13", "28/02/22": "2022-02-28", "20.06.25": "2020-06-25",
            "2022.03.05": "2022-03-05", "16/07/2026": "2026-07-16", "05.20.24": "2024-05-20", "nothing": "NONE"}
    t = token_table({k: [k] for k in want})
    out = predict(t, t.select("image_id"), "union_spatial", {"allow_day_first": True, "allow_month_names": True}, store=lambda df: df)
    assert {r.image_id: r.final_date for r in out.collect()} == want


def test_lone_manufacture_date_is_still_selected(token_table):
    t = token_table({"s": [("제조일자", .95, (10, 10, 50, 25)), ("2024.01.01", .91, (60, 10, 110, 25))]})
    assert best(t)["s"].year == "2024"


def test_unknown_names_are_rejected():
    for call in (lambda: S.selector("x"), lambda: N.normalizer("x"), lambda: S.with_overrides(S.ScoreParams(), nothing=1)):
        with pytest.raises(ValueError):
            call()


def test_normalizer_reads_invalid_candidates_again(spark):
    rows = [("a", "2026.02.31", "2026", "02", "31", False, "ymd_separated", 0.5, ["calendar_invalid"]),
            ("b", "2026.02.03", "2026", "02", "33", False, "ymd_separated", 0.5, ["calendar_invalid"]), ("c",) + (None,) * 8]
    df = spark.createDataFrame(rows, "image_id string, raw_text string, year string, month string, day string, calendar_valid boolean, pattern string, score double, evidence array<string>")
    got = {r.image_id: r for r in N.normalize_prediction(df).collect()}
    assert got["a"].final_date == "NONE" and got["a"].evidence[-1] == "normalization_failed"
    assert got["b"].final_date == "2026-02-03" and got["c"].final_date == "NONE" and got["c"].evidence == []


def big_image(token_table, n=60):
    rnd = random.Random(3)
    words = ["소비기한", "LOT", "x", "EXP"]
    def tok(i):
        box = None if i % 9 == 0 else (rnd.randint(0, 300), rnd.randint(0, 300))
        box = box and (box[0], box[1], box[0] + 60, box[1] + 15)
        text = words[i // 5 % 4] if i % 5 == 0 else f"20{rnd.randint(20, 26)}.{rnd.randint(1, 12):02d}.{rnd.randint(1, 28):02d}"
        return (text, rnd.random(), box, "yolo" if i % 2 else "baseline", rnd.random())
    return token_table({"big": [tok(i) for i in range(n)], "small": [tok(i) for i in range(6)]})


def test_tiles_do_not_change_results(token_table, monkeypatch):
    """A huge image is cut into tiles and keyword blocks; every result stays the same."""
    t = big_image(token_table)
    def run():
        scored = scored_candidates(t, store=lambda df: df)
        cols = ["image_id", "cand_ordinal", F.round("score", 9).alias("score"), "evidence"]
        a = sorted(map(str, scored.select(*cols).collect()))
        b = sorted(map(str, S.other_source_iou(scored).select("image_id", "cand_ordinal", F.round("spatial", 9)).collect()))
        c = sorted(map(str, S.rank_candidates(scored).select("image_id", "cand_ordinal", "rank").collect()))
        return a, b, c
    whole = run()
    monkeypatch.setattr(schemas, "TILE_TOKENS", 7)
    monkeypatch.setattr(S, "KEYWORDS_PER_BLOCK", 3)
    assert run() == whole


def test_rank_with_many_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(schemas, "TILE_TOKENS", 4)
    rows = [("h", i * schemas.ORDINAL_STRIDE, 0.5 if i % 3 else float(i % 7)) for i in range(200)] + [("o", 0, 1.0)]
    df = spark.createDataFrame(rows, "image_id string, cand_ordinal long, score double")
    got = {(r.image_id, r.cand_ordinal): r.rank for r in S.rank_candidates(df).collect()}
    want = {}
    for image in "ho":
        order = sorted([r for r in rows if r[0] == image], key=lambda r: (-r[2], r[1]))
        want.update({(r[0], r[1]): i + 1 for i, r in enumerate(order)})
    assert got == want
