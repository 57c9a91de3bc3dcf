"""Queries over parameter searches, ablations and weight fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from expirylens.operators import search as Q, selection as S
from expirylens.operators.candidates import annotated_candidates, candidates_from_detector, candidates_under
from expirylens.operators.ordering import in_one_tile
from expirylens.plans import fixtures as X
from expirylens.plans.catalog import query
from expirylens.plans.oracle_parts import sql
from expirylens.plans.queries_core import _POOL, pool
from expirylens.plans.storage import materialise
from expirylens.schemas import tile_of


def annotated(spark, d):
    """The candidates under all settings of the parser, from one extraction, shared by the queries of a session."""
    return X.stored(spark, d, "annotated", lambda: annotated_candidates(X.tokens(spark, d), materialise=materialise), store=None)


# candidates at the three parser levels: 0 neither flag, 1 day first, 2 both
_LEVELS = {
    "lv": """SELECT l.lv, c.image_id, c.rn, c.form, c.d, c.conf, c.det, c.source, c.x1, c.y1, c.x2, c.y2, strftime(c.d, '%Y-%m-%d') AS iso,
        l.lv = 0 AND c.form = 2 AS part, (CASE WHEN c.form = 2 AND l.lv = 0 THEN 0.70 WHEN c.form IN (2, 4) THEN 0.92 WHEN c.form = 3 THEN 0.9 ELSE 1.0 END)::DOUBLE AS rel
        FROM dt c, (SELECT unnest([0, 1, 2]) AS lv) l WHERE c.form IN (0, 1, 3) OR (c.form = 2 AND (l.lv > 0 OR day(c.d) <= 12))
        OR (c.form = 4 AND l.lv = 2 AND month(c.d) <> 10)""",
    "le": "SELECT lv, image_id, min(d) AS mn, max(d) AS mx FROM lv WHERE NOT part GROUP BY ALL",
    "lc": """SELECT v.*, e.mn, e.mx, k.k, CASE WHEN k.k IS NULL THEN 0.0 ELSE
        least(1.5, 1.0 / (1.0 + 4.0 * (sqrt((30.0 - (x1 + x2) / 2) ** 2 + (29.0 - (y1 + y2) / 2) ** 2) / greatest(1.0, x2, y2, 60.0, 38.0)))
        + CASE WHEN abs(29.0 - (y1 + y2) / 2) <= 18.0 THEN 0.15 WHEN (y1 + y2) / 2 >= 29.0 THEN 0.15 * 0.75 ELSE 0.0 END) END AS spatial
        FROM lv v LEFT JOIN le e USING (lv, image_id) LEFT JOIN kw k USING (image_id)""",
    "lf": """SELECT c.*, CASE WHEN k IN (0, 1) THEN least(1.5, 1.0 / (1.0 + rn) + spatial) ELSE 0.0 END AS positive,
        CASE WHEN k IN (2, 3) THEN least(1.5, 1.0 / (1.0 + rn) + spatial) ELSE 0.0 END AS negative,
        coalesce(NOT part AND mx > mn AND d = mx, false) AS is_latest, coalesce(NOT part AND mx > mn AND d = mn, false) AS is_min,
        NOT part AND iso = l.final_date AS correct, l.final_date AS target, l.o_orderkey FROM lc c JOIN lab l USING (image_id)""",
    "ev0": "SELECT DISTINCT t.image_id, l.final_date FROM tok t JOIN lab l USING (image_id)"}

_SCORE = """w.conf * f.conf + w.det * f.det + w.cal * 1.0 + w.pat * f.rel + w.kw * f.positive - w.neg * f.negative + w.pos * f.spatial
    - CASE WHEN f.part AND f.mx IS NOT NULL THEN w.part ELSE 0.0 END
    + CASE WHEN is_latest THEN w.fut WHEN is_min AND positive = 0 THEN w.fut * -0.5 ELSE 0.0 END
    + CASE WHEN form = 2 AND NOT f.part THEN 0.4 ELSE 0.0 END"""


_W = "i, lv, kw, neg, conf, det, cal, pat, pos, part, fut"


def _evaluated(weights: str) -> dict[str, str]:
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in _W.split(", ")[2:])
    return {**_LEVELS, "w": f"SELECT i, lv, {doubles} FROM ({weights})",
            "top": f"""SELECT * FROM (SELECT w.i, f.image_id, f.correct, row_number() OVER (PARTITION BY w.i, f.image_id ORDER BY {_SCORE} DESC, rn) AS r
                FROM w JOIN lf f ON f.lv = w.lv) WHERE r = 1""",
            "res": """SELECT w.i, count(*) AS total, sum(CASE WHEN t.image_id IS NULL THEN (e.final_date = 'NONE')::INT ELSE t.correct::INT END) AS correct,
                sum((t.image_id IS NULL)::INT) AS none_predictions, sum((e.final_date <> 'NONE')::INT) AS targets,
                sum((e.final_date <> 'NONE' AND EXISTS (SELECT 1 FROM lf WHERE lf.lv = w.lv AND lf.image_id = e.image_id AND lf.correct))::INT) AS covered
                FROM w CROSS JOIN ev0 e LEFT JOIN top t ON t.i = w.i AND t.image_id = e.image_id GROUP BY w.i"""}


_GRID = {"keyword_weight": [0.3, 0.9], "position_weight": [0.0, 0.25], "future_date_bonus": [0.0, 0.05, 0.3]}
_GRID_W = """SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS i, 2 AS lv, a AS kw, 0.45 AS neg, 0.2 AS conf, 0.2 AS det, 0.5 AS cal, 0.25 AS pat, b AS pos, 0.45 AS part, c AS fut
    FROM (SELECT unnest([0.3, 0.9]) AS a), (SELECT unnest([0.0, 0.25]) AS b), (SELECT unnest([0.0, 0.05, 0.3]) AS c)"""


@query("a10_grid_search", sql("""SELECT round(correct / total, 4) AS final_date_exact_match, round(covered / targets, 4) AS candidate_recall, round(correct / covered, 4) AS candidate_selection_accuracy,
    correct AS correct_count, total AS total_images, round(none_predictions / total, 4) AS none_rate, kw::DOUBLE AS keyword_weight, pos::DOUBLE AS position_weight, fut::DOUBLE AS future_date_bonus
    FROM res JOIN w USING (i)""", "dt", "kw", "tok", "lab", **_evaluated(_GRID_W)))
def a10(spark, d):
    return Q.grid_search(X.features(spark, d), X.labels(spark, d), X.tokens(spark, d), _GRID).drop("combo")


@query("a10_grid_search_full")
def a10_full(spark, d):
    """The whole default search space of 7776 weight sets; checked against brute force in tests."""
    return Q.grid_search(X.features(spark, d), X.labels(spark, d), X.tokens(spark, d)).drop("combo")


_STAGES_W = f"""SELECT * FROM (VALUES (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 0.2, 0.2, 0.5, 0.2, 0.0, 0.0, 0.0),
    (2, 0, 0.5, 0.0, 0.2, 0.2, 0.5, 0.2, 0.0, 0.0, 0.0), (3, 0, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.0, 0.0, 0.0), (4, 1, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.0, 0.0, 0.0),
    (5, 2, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.0, 0.0, 0.0), (6, 2, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.15, 0.0, 0.0), (7, 2, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.15, 0.35, 0.0),
    (8, 2, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.15, 0.35, 0.0), (9, 2, 0.5, 0.3, 0.2, 0.2, 0.5, 0.2, 0.15, 0.35, 0.15)) AS v({_W})"""
_STAGE_NAMES = ", ".join(f"'{n}'" for n, _ in Q.ablation_stages())


@query("a9_stage_ablation", sql(f"""SELECT stage, exact_match, correct, total, round(delta, 4) AS delta_em,
    CASE WHEN i = 0 OR delta >= 0.005 THEN 'KEEP' WHEN delta = 0 THEN 'NEUTRAL' ELSE 'PRUNE' END AS decision FROM (
    SELECT i, [{_STAGE_NAMES}][i + 1] AS stage, round(correct / total, 4) AS exact_match, correct, total,
    round(correct / total, 4) - coalesce(lag(round(correct / total, 4)) OVER (ORDER BY i), round(correct / total, 4)) AS delta FROM res)""",
    "dt", "kw", "tok", "lab", **_evaluated(_STAGES_W)))
def a9(spark, d):
    return Q.stage_ablation(X.tokens(spark, d), X.labels(spark, d), annotated=annotated(spark, d))


_CART_W = """SELECT row_number() OVER (ORDER BY l, k, p) - 1 AS i, l AS lv, [0.7, 0.2][k] AS kw, 0.45 AS neg, 0.2 AS conf, 0.2 AS det, 0.5 AS cal, 0.25 AS pat, [0.25, 0.1][p] AS pos, 0.45 AS part, 0.15 AS fut
    FROM (SELECT unnest([0, 1]) AS l), (SELECT unnest([1, 2]) AS k), (SELECT unnest([1, 2]) AS p)"""


@query("a11_cartesian_ablation", sql("""SELECT printf('run_%03d', i + 1) AS run, round(correct / total, 6) AS final_date_exact_match, round(covered / targets, 6) AS candidate_recall,
    round(correct / covered, 6) AS candidate_selection_accuracy, total AS labeled_count, lv = 1 AS allow_day_first, kw::DOUBLE AS keyword_weight, pos::DOUBLE AS position_weight FROM res JOIN w USING (i)""", "dt", "kw", "tok", "lab", **_evaluated(_CART_W)))
def a11(spark, d):
    grid = {"selector.params.allow_day_first": [False, True], "selector.params.keyword_weight": [0.7, 0.2], "selector.params.position_weight": [0.25, 0.1]}
    out = Q.cartesian_ablation(X.tokens(spark, d), X.labels(spark, d), grid, annotated=annotated(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("final_date_exact_match", "candidate_recall", "candidate_selection_accuracy")]
    return out.select("run", *rounded, "labeled_count", "allow_day_first", "keyword_weight", "position_weight")


_MULT = {**_LEVELS, "mm": "SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS m",
         "mt": """SELECT * FROM (SELECT m, image_id, correct, row_number() OVER (PARTITION BY m, image_id ORDER BY
            0.2 * (conf * CASE WHEN source = 'yolo' THEN m ELSE 1.0 END) + 0.2 * det + 0.5 + 0.25 * rel + 0.7 * positive - 0.45 * negative + 0.25 * spatial
            + CASE WHEN is_latest THEN 0.15 WHEN is_min AND positive = 0 THEN -0.075 ELSE 0.0 END + CASE WHEN form = 2 THEN 0.4 ELSE 0.0 END DESC, rn) AS r
            FROM mm, lf WHERE lv = 2) WHERE r = 1"""}


@query("a14_source_multiplier_sweep", sql("""SELECT m::DOUBLE AS multiplier, round(sum(ok) / count(*), 6) AS final_em, round(sum(cov) / sum((final_date <> 'NONE')::INT), 6) AS candidate_recall,
    round(sum(ok) / sum(cov), 6) AS selection_accuracy FROM (SELECT m, e.final_date, CASE WHEN t.image_id IS NULL THEN (e.final_date = 'NONE')::INT ELSE t.correct::INT END AS ok,
    (e.final_date <> 'NONE' AND EXISTS (SELECT 1 FROM lf WHERE lf.lv = 2 AND lf.image_id = e.image_id AND lf.correct))::INT AS cov
    FROM mm CROSS JOIN ev0 e LEFT JOIN mt t USING (m, image_id)) GROUP BY m""", "dt", "kw", "tok", "lab", **_MULT))
def a14(spark, d):
    return Q.source_multiplier_sweep(X.tokens(spark, d), X.labels(spark, d), "yolo", X.PARAMS).select(
        "multiplier", *[F.round(c, 6).alias(c) for c in ("final_em", "candidate_recall", "selection_accuracy")])


_FIT = {**_POOL, "lw": "SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM lab",
        "pt": "SELECT p.*, l.final_date AS target, l.split, coalesce(p.prediction = l.final_date, false) AS correct FROM pool p JOIN lw l USING (image_id)"}


def _fit(weights: str, rank: str) -> dict[str, str]:
    return {**_FIT, "w": weights,
            "tp": f"SELECT * FROM (SELECT i, p.image_id, p.split, p.correct, row_number() OVER (PARTITION BY i, p.image_id ORDER BY {rank} DESC, o, o2, rn) AS r FROM w, pts p) WHERE r = 1",
            "tot": "SELECT split, count(*) AS images FROM lw GROUP BY 1",
            "fo": "SELECT split, count(DISTINCT image_id) AS found FROM pt WHERE correct GROUP BY 1",
            "rs": """SELECT i, split, images, found / images AS candidate_recall, sum(correct::INT) / images AS final_em, sum(correct::INT) / found AS selection_accuracy
                FROM tp JOIN tot USING (split) JOIN fo USING (split) GROUP BY i, split, images, found""",
            "bs": "SELECT i FROM rs WHERE split = 'train' ORDER BY final_em DESC, selection_accuracy DESC, candidate_recall DESC, i LIMIT 1"}


def _halves(spark, d):
    even = F.substring("image_id", 5, 8).cast("int") % 2 == 0
    lab = X.labels(spark, d)
    return lab.filter(even), lab.filter(~even)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("candidate_recall", "final_em", "selection_accuracy") else c for c in df.columns])


_SRC_W = """SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS i, a AS baseline_source, b AS yolo_bonus, c AS candidate_score
    FROM (SELECT unnest([0.0, 1.0]) AS a), (SELECT unnest([0.0, 1.0]) AS b), (SELECT unnest([0.5, 2.0]) AS c)"""
_SRC_RANK = """CASE WHEN source = 'baseline' THEN baseline_source ELSE 0.25 + yolo_bonus END + candidate_score * score + 0.25 * ln(greatest(rec, 1e-6))
    + 0.1 * ln(greatest(det, 1e-6)) + 0.1 * (class = 1)::INT"""


@query("a12_fit_source_weights", sql("""SELECT split, images, round(candidate_recall, 6) AS candidate_recall, round(final_em, 6) AS final_em, round(selection_accuracy, 6) AS selection_accuracy,
    baseline_source::DOUBLE AS baseline_source, yolo_bonus::DOUBLE AS yolo_bonus, candidate_score::DOUBLE AS candidate_score FROM rs JOIN bs USING (i) JOIN w USING (i)""",
    "sc", "det", "lab", **{**_fit(_SRC_W, _SRC_RANK), **{}}).replace("FROM w, pts p)", "FROM w, pt p)"))
def a12(spark, d):
    train, val = _halves(spark, d)
    grid = {"baseline_source": [0.0, 1.0], "yolo_bonus": [0.0, 1.0], "candidate_score": [0.5, 2.0], "yolo_source": [0.25], "rec_log": [0.25], "det_log": [0.1], "due_bonus": [0.1]}
    p = pool(spark, d)
    return _rounded(Q.fit_weights("source", p, train, p, val, grid)).drop("yolo_source", "rec_log", "det_log", "due_bonus")


_SPA_W = """SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS i, a AS spatial_w, b AS yolo_bonus, c AS candidate_score
    FROM (SELECT unnest([0.0, 0.5, 2.0]) AS a), (SELECT unnest([0.0, 1.5]) AS b), (SELECT unnest([0.5, 2.0]) AS c)"""
_SPA_RANK = """CASE WHEN source = 'yolo' THEN yolo_bonus ELSE 0.0 END + candidate_score * score + 0.5 * ln(greatest(rec, 1e-6)) + 0.1 * ln(greatest(det, 1e-6)) + spatial_w * spatial"""
_IOU = """greatest(0.0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"""


def in_single_tiles(spark, d) -> bool:
    """Whether each image of the pool is one tile."""
    return (in_one_tile(X.tokens(spark, d), tile_of(F.col("token_index")))
            and in_one_tile(X.detector_once(spark, d), tile_of(F.col("candidate_index"))))


def spatial_pool(spark, d, single: bool):
    """The pool with its overlaps. Where each image is one tile it is worked out in the one pass that reads it, only boxes before."""
    if not single:
        return X.stored(spark, d, "pool_spatial", lambda: Q.pool_spatial(pool(spark, d).drop("pool_ordinal")))
    detector = candidates_from_detector(X.detector_once(spark, d))
    cands = X.candidates(spark, d) if X.has_stored(spark, d, "candidates") else candidates_under(annotated(spark, d), True, True)
    pooled = lambda scored, detector: Q.union_pool(S.baseline_pool(scored), detector, single=True)
    # detector rows are placed as the features are, so that the pool of both is not shuffled again
    return Q.pool_spatial(pooled(X.scored_once(spark, d, cands, one_tile=True), detector.repartition("image_id")),
                          pooled(cands.withColumn("score", F.lit(0.0)), detector), single=True)


@query("a13_fit_spatial_weights", sql("""SELECT split, images, round(candidate_recall, 6) AS candidate_recall, round(final_em, 6) AS final_em, round(selection_accuracy, 6) AS selection_accuracy,
    spatial_w::DOUBLE AS spatial, yolo_bonus::DOUBLE AS yolo_bonus, candidate_score::DOUBLE AS candidate_score FROM rs JOIN bs USING (i) JOIN w USING (i)""",
    "sc", "det", "lab", **{k: v for k, v in {**_FIT, "pts": f"""SELECT p.*, coalesce((SELECT max({_IOU} / greatest(1e-9, 2 * 80.0 * 18.0 - {_IOU})) FROM pool q
        WHERE q.image_id = p.image_id AND q.source <> p.source), 0.0) AS spatial FROM pt p""", **_fit(_SPA_W, _SPA_RANK)}.items()}))
def a13(spark, d):
    X.share_lines(spark, d)
    train, val = _halves(spark, d)
    grid = {"spatial": [0.0, 0.5, 2.0], "yolo_bonus": [0.0, 1.5], "candidate_score": [0.5, 2.0], "rec_log": [0.5], "det_log": [0.1]}
    single = in_single_tiles(spark, d)
    p = spatial_pool(spark, d, single)
    return _rounded(Q.fit_weights("spatial", p, train, p, val, grid, single=single)).drop("rec_log", "det_log")
