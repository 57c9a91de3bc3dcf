"""Lines, search, boxes, audits and orderings against brute force on small tables."""

import itertools
import math
import random

from pyspark.sql import functions as F

from expirylens import schemas
from expirylens.operators import audit as A, boxes as B, filters as O, lines as L, ordering, routing as R, search as Q, selection as S
from expirylens.operators.candidates import extract_candidates
from expirylens.plans.flows import scored_candidates

NO_STORE = lambda df: df


def fold_lines(tokens, tol=0.6):
    """Independent statement of row grouping: first row whose mean centre is near enough."""
    boxed = [(i, t) for i, t in enumerate(tokens) if t[2]]
    groups = []
    for i, t in sorted(boxed, key=lambda x: ((x[1][2][1] + x[1][2][3]) / 2, x[1][2][0])):
        cy, h = (t[2][1] + t[2][3]) / 2, max(1.0, t[2][3] - t[2][1])
        for g in groups:
            if abs(cy - sum(x[1] for x in g) / len(g)) <= tol * max(h, max(x[2] for x in g)):
                g.append((i, cy, h))
                break
        else:
            groups.append([(i, cy, h)])
    out = []
    for g in groups:
        idx = [x[0] for x in sorted(g, key=lambda x: tokens[x[0]][2][0])]
        out.append(" ".join(tokens[i][0] for i in idx))
    rest = [t[0] for t in tokens if not t[2]]
    return out + ([" ".join(rest)] if rest else [])


def test_lines_match_fold_and_large_images_are_cut(token_table, monkeypatch):
    rnd = random.Random(5)
    images = {}
    for k in range(6):
        toks = []
        for i in range(25):
            x, y, h = rnd.randint(0, 400), rnd.randint(0, 40) + 150 * rnd.randint(0, 3), rnd.randint(8, 22)
            toks.append((f"w{i}", 0.9, None if i % 12 == 5 else (x, y, x + 30, y + h)))
        images[f"i{k}"] = toks
    t = token_table(images)
    def run():
        rows = L.reconstruct_lines(t).orderBy("image_id", "line_ordinal").collect()
        return {k: [r.text for r in rows if r.image_id == k] for k in images}
    want = {k: fold_lines(v) for k, v in images.items()}
    assert run() == want
    monkeypatch.setattr(L, "MAX_TOKENS_IN_ONE_FOLD", 3)
    assert run() == want


def labelled_images(token_table, spark):
    rnd = random.Random(9)
    images, labels = {}, []
    for k in range(25):
        toks = [("EXP" if k % 2 else "제조일", 0.9, (0, 0, 40, 20))]
        dates = [f"20{rnd.randint(20, 26)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}" for _ in range(rnd.randint(0, 4))]
        for j, d in enumerate(dates):
            toks.append((d.replace("-", "."), round(rnd.random(), 2), (50, 20 * j, 130, 20 * j + 18)))
        images[f"i{k}"] = toks
        labels.append((f"i{k}", rnd.choice(dates + ["NONE"])))
    return token_table(images), spark.createDataFrame(labels, "image_id string, final_date string")


def test_grid_search_equals_one_run_per_weight_set(token_table, spark, monkeypatch):
    t, labels = labelled_images(token_table, spark)
    grid = {"keyword_weight": [0.0, 0.9], "confidence_weight": [0.2, 2.0], "future_date_bonus": [0.0, 0.5]}
    cands = extract_candidates(t)
    def run():
        rows = Q.grid_search(S.features(cands, t), labels, t, grid).collect()
        return {(r.keyword_weight, r.confidence_weight, r.future_date_bonus): (r.correct_count, r.total_images) for r in rows}
    got = run()
    truth = {r.image_id: r.final_date for r in labels.collect()}
    feats = S.features(cands, t).cache()
    for combo in itertools.product(*grid.values()):
        p = S.ScoreParams(**dict(zip(grid, combo)))
        best = {r.image_id: f"{r.year}-{r.month}-{r.day}" for r in S.select_best(S.score_candidates(feats, p)).collect()}
        assert got[combo] == (sum(best.get(i, "NONE") == d for i, d in truth.items()), 25), combo
    monkeypatch.setattr(schemas, "TILE_TOKENS", 2)      # every image becomes several tiles
    assert run() == got


def test_product_grid_stride_and_stages():
    assert len(Q.product_grid(Q.DEFAULT_GRID)) == 7776
    strided = Q.product_grid(Q.DEFAULT_GRID, 2000, strided=True)
    assert len(strided) == 2000 and strided[1] == Q.product_grid(Q.DEFAULT_GRID)[3]
    assert math.prod(map(len, Q.SOURCE_GRID.values())) == 18000 and math.prod(map(len, Q.SPATIAL_GRID.values())) == 5600
    stages = Q.ablation_stages()
    assert [n[:2] for n, _ in stages] == [f"{i:02d}" for i in range(10)]
    assert stages[0][1]["confidence_weight"] == 0.0 and stages[9][1]["future_date_bonus"] == 0.15 and stages[4][1]["allow_day_first"]


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / max(1e-9, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def test_aligned_boxes_are_trimmed_in_order(token_table, spark):
    rnd = random.Random(1)
    images, rows, labels = {}, [], []
    for k in range(30):
        name = f"i{k:02d}"
        images[name] = [("2026.01.02", 0.9, (50, 50, 130, 70)), ("2025.05.05", 0.9, (50, 90, 130, 110))] if k % 7 else []
        labels.append((name, "2026-01-02" if k % 5 else "2024-01-01"))
        for j in range(rnd.randint(1, 5)):
            x, y = rnd.randint(20, 90), rnd.randint(20, 90)
            rows.append((name, j, rnd.randint(0, 2), (float(x), float(y), float(x + rnd.randint(30, 100)), float(y + rnd.randint(10, 60)))))
    t = token_table(images)
    boxes = spark.createDataFrame(rows, f"image_id string, box_index int, class int, bbox {schemas.BBOX_DDL}")
    lab = spark.createDataFrame(labels, "image_id string, final_date string")
    ids = lab.select("image_id")
    got = {r.image_id: r for r in B.align_boxes_to_candidates(ids, lab, t, scored_candidates(t, store=NO_STORE), boxes).collect()}
    for name, label in labels:
        mine = [r for r in rows if r[0] == name]
        dates = [r for r in mine if r[2] == 0]
        if not images[name]:
            want = "missing_label_or_tokens"
        elif label != "2026-01-02":
            want = "no_matching_ocr_candidate"
        elif not dates:
            want = "no_gt_date_box"
        else:
            best = max(dates, key=lambda r: iou((50, 50, 130, 70), r[3]))
            left, top, right, bottom = best[3]
            for _, _, cls, o in mine:
                wide = max(0.0, min(right, o[2]) - max(left, o[0])) >= 0.25 * max(1.0, min(right - left, o[2] - o[0]))
                if cls == 0 or not wide:
                    continue
                if top <= o[1] < bottom and o[3] > top:
                    bottom = min(bottom, o[1] - 1.0)
                elif top < o[3] <= bottom and o[1] < top:
                    top = max(top, o[3] + 1.0)
            want = "trimmed_box_empty" if right <= left or bottom <= top + 3 else "ok"
            if want == "ok":
                assert tuple(got[name].crop_box) == (left, top, right, bottom), name
        assert got[name].status == want, name


def test_audit_flags(spark, token_table):
    rows = [("clean", "2024", "05", "20", "2024-05-20"), ("bad_cal", "2024", "02", "30", "2024-02-30"), ("old", "1995", "01", "01", "1995-01-01"),
            ("gt", "2022", "10", "15", "2022-10-15"), ("halluc", "2023", "11", "11", "2023-11-11"), ("", "NONE", "NONE", "01", "NONE"), ("form", "2024", "1", "1", "2024/1/1")]
    lab = spark.createDataFrame(rows, "image_id string, year string, month string, day string, final_date string")
    truth = spark.createDataFrame([("clean", "2024-05-20"), ("gt", "2022-10-20")], "image_id string, final_date string")
    t = token_table({"clean": ["2024.05.20"], "bad_cal": ["2024.02.30"], "old": ["1995.01.01"], "gt": ["2022.10.15"], "halluc": ["무관한 글"]})
    a = A.audit_labels(lab, truth, t)
    got = {r.image_id: list(r.flag_types) for r in a.collect()}
    assert got == {"clean": [], "bad_cal": ["CALENDAR_INVALID"], "old": ["YEAR_OUTLIER"], "gt": ["GT_MISMATCH"], "halluc": ["OCR_HALLUCINATION_OR_MISSING"],
                   "": ["MISSING_IMAGE_ID", "FINAL_NONE_BUT_COMPONENTS_SET"], "form": ["INVALID_DATE_FORMAT"]}
    s = A.audit_summary(a).first()
    assert (s.total_images, s.clean_count, s.syntax_errors, s.gt_mismatches, s.token_confirmed) == (7, 1, 3, 1, 4)


def test_token_evidence_across_tiles(spark, token_table, monkeypatch):
    """Dates cut by tile borders, also over tiles without or with few word characters."""
    images = {"a": ["x", "2024.", "-", "-", ".", "-", "05", "20"], "b": ["20", "2", "4", "0", "5", "2", "0"], "c": ["2024", "-", "-", "-", "-", "-", "0520"],
              "d": ["2024", "06", "20"], "e": ["20.05.2024"], "f": ["5", "2024", "-", "20", "05"]}
    t = token_table(images)
    lab = spark.createDataFrame([(k, "2024", "05", "20") for k in images], "image_id string, year string, month string, day string")
    want = {"a": True, "b": True, "c": True, "d": False, "e": True, "f": True}
    for size in (4096, 3, 2, 1):
        monkeypatch.setattr(schemas, "TILE_TOKENS", size)
        assert {r.image_id: r.token_found for r in A.token_evidence(t, lab).collect()} == want, size


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = ordering.with_global_index(df, "v").collect()
    assert sorted((r.v, r.row_index) for r in rows) == [(i, i) for i in range(1000)]


def test_evenly_spaced_positions(spark):
    df = spark.range(101).select(F.format_string("%04d", "id").alias("image_id"))
    for n in (1, 2, 7, 50, 100, 101, None):
        got = sorted(int(r.image_id) for r in O.evenly_spaced_sample(df, n, "image_id").collect())
        want = list(range(101)) if n in (101, None) else [0] if n == 1 else sorted({round(i * 100 / (n - 1)) for i in range(n)})
        assert got == want, n


def test_routing_guards(spark, token_table):
    t = token_table({"fast": [("EXP", 0.9), ("2026.01.02", 0.95)], "neg": [("EXP 제조", 0.9), ("2026.01.02", 0.95)], "low": [("EXP", 0.9), ("2026.01.02", 0.5)]})
    assert [r.image_id for r in R.can_fast_exit(t, extract_candidates(t, True, True)).collect()] == ["fast"]


def test_shard_validates():
    try:
        O.shard(None, 3, 3)
        assert False
    except ValueError:
        pass
