import random

import pytest

from expirylens import schemas
from expirylens.functions.dates import FLAG_PAIRS
from expirylens.operators import search as Q, selection as S
from expirylens.plans.storage import materialise


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def dated_images():
    r = random.Random(8)
    parts = ["2024.05.06", "05/06/2024", "13.05.2023", "06.2025", "12 MAY 2024", "20240506", "05.06", "31.12.25", "2024.13.45", "5월 6일", "10:30", "LOT"]
    images = {}
    for i in range(60):
        images[f"i{i:02d}"] = [(r.choice(parts), r.choice([0.5, 0.9]), (10 * k, 20 * r.randint(0, 3), 10 * k + 40, 20 * k + 18), r.choice(["yolo", "baseline"]), 0.7)
                               for k in range(r.randint(1, 5))]
        if i % 3:
            images[f"i{i:02d}"] += [(w, 0.9, (0, 20 * k, 30, 20 * k + 15), "baseline", 0.9) for k, w in enumerate(r.sample(["EXP", "LOT", "제조일자", "까지"], i % 3))]
    images["line"] = [(t, 0.8, (30 * i, 0, 30 * i + 20, 10), "yolo", 0.5) for i, t in enumerate(["12", "MAY", "2024"])]
    images["bare"] = [("no date", 0.9, None, "yolo", 0.5)]
    return images


SHOWN = {"2024.05.06": "2024-05-06", "05/06/2024": "2024-06-05", "13.05.2023": "2023-05-13", "12 MAY 2024": "2024-05-12", "20240506": "2024-05-06",
         "31.12.25": "2025-12-31", "06.2025": "unreadable"}


def dated_labels(spark, images):
    rows = []
    for n, (image, tokens) in enumerate(images.items()):
        dates = [SHOWN[t[0]] for t in tokens if t[0] in SHOWN] or ["NONE"]
        rows.append((image, dates[n % len(dates)]))
    return materialise(spark.createDataFrame([*rows, ("no tokens", "NONE")], "image_id string, final_date string"))


SETS = [{"allow_day_first": d, "allow_month_names": m, "keyword_weight": w, "partial_date_penalty": p, "future_date_bonus": b}
        for (d, m), w, p, b in ((FLAG_PAIRS[0], 0.0, 0.0, 0.0), (FLAG_PAIRS[0], 0.7, 0.45, 0.15), (FLAG_PAIRS[1], 0.1, 2.0, -0.3), (FLAG_PAIRS[3], 0.7, 0.45, 0.15))]


@pytest.mark.parametrize("tile, block, both", [(4096, 1, True), (2, 1024, False)])
def test_settings_evaluated_together_equal_separate_searches(spark, token_table, monkeypatch, tile, block, both):
    monkeypatch.setattr(schemas, "TILE_TOKENS", tile)
    monkeypatch.setattr(S, "KEYWORDS_PER_BLOCK", block)
    tokens = materialise(token_table(dated_images()))
    labels = dated_labels(spark, dated_images())
    run = lambda: sorted(tuple(r[c] for c in ("combo", "correct", "total", "targets", "covered"))
                         for r in Q.evaluate_params(tokens, labels, SETS, both_unreadable=both).collect())
    together = run()
    assert len({r[1] for r in together}) > 2
    monkeypatch.setattr(Q, "FEW_SETS", 0)
    assert run() == together


def test_all_settings_share_one_shuffle_of_candidates(spark, token_table):
    tokens = materialise(token_table(dated_images()))
    labels = dated_labels(spark, dated_images())
    planned = [exchanges(Q.evaluate_params(tokens, labels, [{"allow_day_first": d, "allow_month_names": m} for d, m in FLAG_PAIRS[:n]])) for n in (1, 4)]
    assert planned[0] == planned[1]
    assert Q.stage_ablation(tokens, labels).count() == 10


def test_no_images_and_no_tokens(spark, token_table):
    tokens = materialise(token_table(dated_images()))
    labels = dated_labels(spark, dated_images())
    for t, lab in ((tokens.filter("false"), labels), (tokens, labels.filter("false"))):
        assert sorted((r.combo, r.correct, r.total, r.covered) for r in Q.evaluate_params(t, lab, SETS[:2]).collect()) == [(0, 0, 0, 0), (1, 0, 0, 0)]


POOL = ("image_id string, o1 int, o2 double, o3 long, source string, prediction string, score double, rec double, det double, class int, "
        "is_yolo boolean, is_due boolean, log_rec double, log_det double, tile int, last_tile int, bbox struct<x1:double,y1:double,x2:double,y2:double>")


def pools(spark):
    """Images with a few boxes, with more than are compiled, and with more than one cell holds."""
    r, rows, sizes = random.Random(3), [], [2, 3, 5, 8, 9, 17, 18, 40, 150]
    for n, size in enumerate(sizes * 3):
        for k in range(size):
            yolo, x, box = k % 2, 7.0 * r.randint(0, 9), r.random() < 0.9
            rows.append((f"i{n}", yolo, 0.0 if yolo else -r.choice([0.5, 1.0]), k if yolo else k << 20, "yolo" if yolo else "baseline",
                         f"2024-01-0{r.randint(1, 4)}", r.choice([0.5, 1.0]), 0.5, 0.5, k % 3, bool(yolo), k % 3 == 1, r.choice([0.0, -0.7]), -0.5, 0, 0,
                         (x, 0.0, x + 20.0, 18.0) if box else None))
    labels = [(f"i{n}", f"2024-01-0{n % 5 + 1}") for n in range(3 * len(sizes))] + [("none", "NONE"), ("i0", "2024-01-02")]
    return materialise(spark.createDataFrame(rows, POOL)), materialise(spark.createDataFrame(labels, "image_id string, final_date string"))


def rows_of(df):
    return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())


def test_overlaps_of_a_pool_read_from_stored_boxes(spark):
    pool, _ = pools(spark)
    few = pool.join(pool.groupBy("image_id").count().filter("count < 100").select("image_id"), "image_id", "left_semi")
    for p in (pool, few):
        assert rows_of(Q.pool_spatial(p, materialise(p), single=True)) == rows_of(Q.pool_spatial(p))


@pytest.mark.parametrize("kind", ["source", "spatial"])
def test_a_pool_is_read_once_for_a_fit(spark, monkeypatch, kind):
    pool, labels = pools(spark)
    pool = materialise(Q.pool_spatial(pool))
    train, val = labels.filter("image_id < 'i2'"), labels.filter("image_id >= 'i14'")      # some images are in both
    grid = {"spatial": {"spatial": [0.0, 0.5, 2.0], "yolo_bonus": [0.0, 1.5], "candidate_score": [0.5], "rec_log": [0.5], "det_log": [0.1]},
            "source": {"baseline_source": [0.0, 1.0], "yolo_source": [0.25], "yolo_bonus": [0.0, 1.0], "candidate_score": [0.5, 2.0], "rec_log": [0.25],
                       "det_log": [0.1], "due_bonus": [0.1]}}[kind]
    fit = lambda v: Q.fit_weights(kind, pool, train, pool if v else pool.filter("true"), val, grid)
    out = fit(True)
    assert not set(out.inputFiles()) & set(pool.inputFiles())
    together = rows_of(out)
    assert len(together) == 2 and rows_of(fit(False)) == together
    monkeypatch.setattr(Q, "FEW_SETS", 0)
    assert rows_of(fit(True)) == together
    assert rows_of(Q.fit_weights(kind, pool, train.filter("false"), grid=grid))[0].count("('final_em', 0.0)") == 1
