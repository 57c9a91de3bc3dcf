"""Parameter search: score many weight sets over one table of candidate features.

Candidates are features plus "is this the labelled date", gathered once into one row per
(image, tile); a tile is bounded, so no row grows with the image. The weight sets are a small
constant. Each task evaluates all sets over its rows with array arithmetic and returns counts per
set, so nothing is multiplied out into rows and only counts are shuffled. Images that span several
tiles return their best candidate per tile instead, and those are compared in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.functions.dates import candidate_final_date, final_date_sql
from expirylens.operators import selection as S
from expirylens.operators.candidates import annotated_candidates, candidates_under, candidates_with_places, extract_candidates
from expirylens.operators.filters import last_per_id
from expirylens.operators.ordering import in_one_tile, join_by_tile
from expirylens.plans.storage import materialise
from expirylens.schemas import tile_of

# The search space of the selector weights.
DEFAULT_GRID = {
    "keyword_weight": [0.3, 0.5, 0.7, 0.9],
    "negative_keyword_weight": [0.15, 0.3, 0.45, 0.6],
    "calendar_weight": [0.3, 0.5, 0.8],
    "pattern_weight": [0.1, 0.2, 0.3],
    "position_weight": [0.0, 0.15, 0.25],
    "partial_date_penalty": [0.2, 0.35, 0.5],
    "time_like_penalty": [0.3, 0.5, 0.7],
    "future_date_bonus": [0.0, 0.05],
}
# The spaces of the two union weight fits.
SOURCE_GRID = {
    "baseline_source": [0.0, 0.25, 0.5, 1.0, 1.5], "yolo_source": [0.0, 0.25, 0.5, 1.0, 1.5],
    "yolo_bonus": [0.0, 0.25, 0.5, 1.0, 2.0], "candidate_score": [0.5, 1.0, 2.0],
    "rec_log": [0.0, 0.25, 0.5, 1.0], "det_log": [0.0, 0.1, 0.25, 0.5], "due_bonus": [0.0, 0.1, 0.25],
}
SPATIAL_GRID = {
    "spatial": [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0], "yolo_bonus": [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0],
    "candidate_score": [0.5, 0.75, 1.0, 1.5, 2.0], "rec_log": [0.5, 0.75, 1.0, 1.5],
    "det_log": [0.0, 0.1, 0.25, 0.5, 1.0],
}
# The cumulative ablation stages and their base.
ABLATION_BASE = {"keyword_weight": 0.0, "negative_keyword_weight": 0.0, "confidence_weight": 0.2,
                 "detection_confidence_weight": 0.2, "calendar_weight": 0.0, "pattern_weight": 0.2,
                 "position_weight": 0.0, "partial_date_penalty": 0.0, "time_like_penalty": 0.0,
                 "future_date_bonus": 0.0, "allow_day_first": False, "allow_month_names": False}
ABLATION_STEPS = [
    ("01_+calendar_priority", {"calendar_weight": 0.5}),
    ("02_+keyword_scoring", {"keyword_weight": 0.5}),
    ("03_+negative_keywords", {"negative_keyword_weight": 0.3}),
    ("04_+day_first_dmy", {"allow_day_first": True}),
    ("05_+month_names", {"allow_month_names": True}),
    ("06_+position_prior", {"position_weight": 0.15}),
    ("07_+partial_penalty", {"partial_date_penalty": 0.35}),
    ("08_+time_penalty", {"time_like_penalty": 0.50}),
    ("09_+future_bonus_full", {"future_date_bonus": 0.15}),
]


def product_grid(grid: dict[str, list], limit: int | None = None, strided: bool = False) -> list[dict]:
    """All combinations in product order; cut to ``limit`` from the front or with a stride."""
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if limit is None or len(combos) <= limit:
        return combos
    return [combos[i * len(combos) // limit] for i in range(limit)] if strided else combos[:limit]


def ablation_stages() -> list[tuple[str, dict]]:
    bare = {k: (False if isinstance(v, bool) else 0.0) for k, v in ABLATION_BASE.items()}
    stages, current = [("00_bare_regex", bare)], dict(ABLATION_BASE)
    for name, change in ABLATION_STEPS:
        current = {**current, **change}
        stages.append((name, dict(current)))
    return stages


# --- evaluation of many weight sets --------------------------------------------------------------

_CHUNK = 64          # weight sets evaluated at a time
FEW_SETS = 32        # so many are scored as columns, which needs no arrays of candidates


def _linear_score(w: dict[str, np.ndarray], f: dict[str, np.ndarray]) -> np.ndarray:
    """score_column for all weight sets at once, with the same order of operations."""
    s = w["confidence_weight"] * (f["recognition_confidence"] * f["source_prior"])
    s = s + w["detection_confidence_weight"] * f["detection_confidence"]
    s = s + w["calendar_weight"] * f["calendar"]
    s = s + w["pattern_weight"] * f["pattern_reliability"]
    s = s + w["keyword_weight"] * f["positive_keyword"]
    s = s - w["negative_keyword_weight"] * f["negative_keyword"]
    s = s + w["position_weight"] * f["spatial_relation"]
    s = s - (w["partial_date_penalty"] * f["is_partial"] + w["time_like_penalty"] * f["is_time_like"])
    bonus = w["future_date_bonus"] * (f["is_latest"] * f["source_prior"]) \
        + w["future_date_bonus"] * -0.5 * (f["is_earliest_bare"] * f["source_prior"])
    return s + bonus + f["dmy_adjustment"]


def _source_score(w, f, where=np.where):
    yolo = f["is_yolo"]
    s = where(yolo > 0, w["yolo_source"] + w["yolo_bonus"], w["baseline_source"])
    s = s + w["candidate_score"] * f["score"]
    s = s + w["rec_log"] * f["log_rec"]
    s = s + w["det_log"] * f["log_det"]
    return s + w["due_bonus"] * f["is_due"]


def _spatial_score(w, f, where=np.where):
    s = where(f["is_yolo"] > 0, w["yolo_bonus"], 0.0)
    s = s + w["candidate_score"] * f["score"]
    s = s + w["rec_log"] * f["log_rec"]
    s = s + w["det_log"] * f["log_det"]
    return s + w["spatial"] * f["spatial"]


# The parts a score is a sum of: (features multiplied, weight, sign). A part without a weight counts as it is; sign 0 marks
# one that only compares when equal.
_PARTS = {
    _linear_score: (
        (("recognition_confidence", "source_prior"), "confidence_weight", 1), (("detection_confidence",), "detection_confidence_weight", 1),
        (("calendar",), "calendar_weight", 1), (("pattern_reliability",), "pattern_weight", 1), (("positive_keyword",), "keyword_weight", 1),
        (("negative_keyword",), "negative_keyword_weight", -1), (("spatial_relation",), "position_weight", 1),
        (("is_partial",), "partial_date_penalty", -1), (("is_time_like",), "time_like_penalty", -1),
        (("is_latest", "source_prior"), "future_date_bonus", 1), (("is_earliest_bare", "source_prior"), "future_date_bonus", -1),
        (("dmy_adjustment",), None, 1)),
    _source_score: ((("is_yolo",), None, 0), (("score",), "candidate_score", 1), (("log_rec",), "rec_log", 1),
                    (("log_det",), "det_log", 1), (("is_due",), "due_bonus", 1)),
    _spatial_score: ((("is_yolo",), None, 0), (("score",), "candidate_score", 1), (("log_rec",), "rec_log", 1),
                     (("log_det",), "det_log", 1), (("spatial",), "spatial", 1))}


def _dominates(score: Callable, combos: list[dict]) -> str:
    """SQL: candidate ``y`` scores at least as much as ``x`` under every weight set.

    Sums and products round monotonically, so part by part comparison holds for the rounded scores too. A weight that is zero
    everywhere leaves its part out, and one with both signs asks for equal parts.
    """
    tests = []
    for features, weight, sign in _PARTS[score]:
        values = [float(c[weight]) for c in combos] if weight else [1.0]
        if not any(values):
            continue
        x, y = (" * ".join(f"{side}.{f}" for f in features) for side in "xy")
        rising = [sign * v > 0 for v in values if v]
        compare = "=" if sign == 0 or len(set(rising)) > 1 else ">=" if rising[0] else "<="
        tests.append(f"{y} {compare} {x}")
    return f"coalesce({' AND '.join(tests) or 'true'}, false)"


def skyline(score: Callable, combos: list[dict]) -> Column:
    """The candidates of the ordered array ``c`` that can win under some weight set.

    One that an earlier one dominates never does: the earlier one scores as much and wins a tie. Such a dominator stays in the
    front, or one that dominates it does, so each candidate is compared with the front only.
    """
    return F.expr(f"aggregate(c, filter(c, x -> false), (front, x) -> IF(exists(front, y -> {_dominates(score, combos)}), "
                  "front, concat(front, array(x))))")


def _ordered_candidates(cands: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates of an image and tile as an array in tie order."""
    item = F.struct(*[F.col(c).cast("double").alias(c) if c not in ("o1", "o3") else F.col(c) for c in fields])
    return cands.groupBy("image_id", "tile").agg(F.array_sort(F.collect_list(item)).alias("c"), F.max("last_tile").alias("last_tile"))


def pruned_work(cands: DataFrame, feature_names: list[str], combos: list[dict], score: Callable = _linear_score) -> DataFrame:
    """One row: candidates, those left by the skyline, and those in images that must be evaluated, without and with it."""
    rows = _ordered_candidates(cands, ["o1", "o2", "o3", "is_correct", *feature_names]).withColumn("front", skyline(score, combos))
    def evaluated(column: str) -> Column:
        right = F.size(F.filter(column, lambda x: x.is_correct > 0))
        return F.when((F.col("last_tile") > 0) | ((right > 0) & (right < F.size(column))), F.size(column)).otherwise(0)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.select(F.size("c").alias("n"), F.size("front").alias("n_front"), evaluated("c").alias("e"), evaluated("front").alias("e_front")).agg(
        whole("n").alias("candidates"), whole("n_front").alias("front"), whole("e").alias("evaluated_before"), whole("e_front").alias("evaluated"))


# Weights of a part that stands without one: they add up to a constant for each value of its feature.
_WEIGHTS_OF = {"is_yolo": ("yolo_source", "yolo_bonus", "baseline_source")}


def _of_images(f: dict[str, np.ndarray], sizes: np.ndarray, chosen: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The candidates of the chosen images (a mask) and their numbers."""
    rows = np.repeat(chosen, sizes)
    return {n: v[rows] for n, v in f.items()}, sizes[chosen]


def _best(score: Callable, names: list[str], part: np.ndarray, f: dict[str, np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per weight set and image the best score and the first candidate that has it."""
    starts = np.cumsum(sizes) - sizes
    position = np.arange(sizes.sum())
    s = score({n: part[:, [i]] for i, n in enumerate(names)}, f)
    top = np.maximum.reduceat(s, starts, axis=1)
    first = np.where(s == np.repeat(top, sizes, axis=1), position, len(position))
    return top, np.minimum.reduceat(first, starts, axis=1)


def _right_images_exactly(score: Callable, names: list[str], weights: np.ndarray, f: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Per weight set the number of images whose best candidate is correct."""
    return np.concatenate([f["is_correct"][_best(score, names, weights[at:at + _CHUNK], f, sizes)[1]].sum(axis=1).astype(np.int64)
                           for at in range(0, len(weights), _CHUNK)])


def _right_images(score: Callable, names: list[str], weights: np.ndarray, f: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The same counts, each image evaluated only under weights that can tell its candidates apart.

    A weight whose feature is equal in all candidates of an image moves their scores alike, so weight sets that agree in the
    other weights choose alike. Images are grouped by the weights that count, and one set stands for all that agree in them.
    Where the best correct and the best wrong candidate are nearer than rounding may reach, all sets are evaluated.
    """
    starts = np.cumsum(sizes) - sizes
    counts, reach = np.zeros((len(sizes), len(names)), dtype=bool), 1.0
    for features, weight, _ in _PARTS[score]:
        x = np.prod([f[n] for n in features], axis=0)
        differs = np.maximum.reduceat(x, starts) != np.minimum.reduceat(x, starts)
        of_part = [names.index(n) for n in ((weight,) if weight else _WEIGHTS_OF.get(features[0], ())) if n in names]
        counts[:, of_part] |= differs[:, None]
        reach += np.abs(x).max() * (np.abs(weights[:, of_part]).max(axis=0).sum() if of_part else 1.0)
    near = 1e-12 * reach        # far above the rounding of a dozen sums
    totals = np.zeros(len(weights), dtype=np.int64)
    masks, mask_of = np.unique(counts, axis=0, return_inverse=True)
    mask_of = mask_of.reshape(-1)
    for m, mask in enumerate(masks):
        own, own_sizes = _of_images(f, sizes, mask_of == m)
        own_starts = np.cumsum(own_sizes) - own_sizes
        shown = np.where(mask, weights, 0.0)      # weights that do not count are one value
        _, first, kind_of = np.unique(shown, axis=0, return_index=True, return_inverse=True)
        kind_of = kind_of.reshape(-1)
        right, unsure = np.zeros(len(first), dtype=np.int64), []
        for at in range(0, len(first), _CHUNK):
            part = weights[first[at:at + _CHUNK]]
            s = score({n: part[:, [i]] for i, n in enumerate(names)}, own)
            good, bad = (np.maximum.reduceat(np.where(side, s, -np.inf), own_starts, axis=1)
                         for side in (own["is_correct"] > 0, own["is_correct"] <= 0))
            sure = np.abs(good - bad) > near
            right[at:at + len(part)] = (sure & (good > bad)).sum(axis=1)
            unsure += [(at + k, ~sure[k]) for k in np.flatnonzero(~sure.all(axis=1))]
        totals += right[kind_of]
        for k, images in unsure:
            every = np.flatnonzero(kind_of == k)
            totals[every] += _right_images_exactly(score, names, weights[every], *_of_images(own, own_sizes, images))
    return totals


def count_correct(cands: DataFrame, feature_names: list[str], combos: list[dict],
                  score: Callable = _linear_score, prune: bool = True) -> DataFrame:
    """Per weight set the number of images whose best candidate is correct: (combo, correct).

    ``cands`` holds image_id, tile, last_tile, the order columns o1, o2, o3 (first wins on equal
    scores), is_correct and the features. With ``prune`` only the skyline of an image is evaluated, and only under weights
    that tell its candidates apart.
    """
    names = list(combos[0])
    weights = np.array([[float(c[n]) for n in names] for c in combos])
    fields = ["o1", "o2", "o3", "is_correct", *feature_names]
    rows = _ordered_candidates(cands, fields)
    if prune:  # behind a generator, so that no filter below pulls the fold down with it
        rows = rows.select("image_id", "tile", "last_tile", F.explode(F.array(F.struct(skyline(score, combos).alias("c")))).alias("__g")).select(
            "image_id", "tile", "last_tile", "__g.c")
    # one kind of candidate only: every weight set gives the same answer
    rows = rows.withColumn("right", F.size(F.filter("c", lambda x: x.is_correct > 0)))
    settled = (F.col("last_tile") == 0) & ((F.col("right") == 0) | (F.col("right") == F.size("c")))
    arrays = rows.select("image_id", "last_tile", F.when(settled, (F.col("right") > 0).cast("int")).alias("settled"),
                         *[F.when(~settled, F.col(f"c.{n}")).alias(n) for n in fields])

    def evaluate(batches: Iterable[pd.DataFrame]):
        totals = np.zeros(len(weights), dtype=np.int64)
        for pdf in batches:
            is_open = pdf["settled"].isna()
            totals += int(pdf["settled"].sum())
            pdf = pdf[is_open]
            if pdf.empty:
                continue
            sizes = pdf["o1"].map(len).to_numpy()
            f = {n: np.concatenate(pdf[n].to_numpy()) for n in fields}
            single = pdf["last_tile"].to_numpy() == 0
            if single.any():
                own, own_sizes = _of_images(f, sizes, single)
                totals += _right_images(score, names, weights, own, own_sizes) if prune else \
                    _right_images_exactly(score, names, weights, own, own_sizes)
            for j in np.flatnonzero(~single):
                mine = _of_images(f, sizes, np.arange(len(sizes)) == j)
                for at in range(0, len(weights), _CHUNK):
                    part = weights[at:at + _CHUNK]
                    top, best = _best(score, names, part, *mine)
                    top, best, of = top[:, 0], best[:, 0], mine[0]
                    yield pd.DataFrame({
                        "image_id": pdf["image_id"].iloc[j], "combo": np.arange(at, at + len(part)),
                        "score": top, "o1": of["o1"][best].astype(int), "o2": of["o2"][best],
                        "o3": of["o3"][best].astype(int), "correct": of["is_correct"][best].astype(int)})
        yield pd.DataFrame({"image_id": None, "combo": np.arange(len(weights)), "score": 0.0, "o1": 0,
                            "o2": 0.0, "o3": 0, "correct": totals})

    parts = arrays.mapInPandas(evaluate, "image_id string, combo int, score double, o1 int, o2 double, o3 long, correct long")
    # totals have no image id; tiles of a huge image compete for each weight set. One aggregate, as parts would be worked out for each reading
    sums = (parts.groupBy("image_id", "combo").agg(
        F.sum("correct").alias("total"),
        F.max_by("correct", F.struct("score", (-F.col("o1")).alias("a"), (-F.col("o2")).alias("b"), (-F.col("o3")).alias("c"))).alias("best"))
        .groupBy("combo").agg(F.sum(F.when(F.col("image_id").isNull(), F.col("total")).otherwise(F.col("best"))).alias("correct")))
    every = cands.sparkSession.range(len(combos)).select(F.col("id").cast("int").alias("combo"))
    return every.join(sums, "combo", "left").select("combo", F.coalesce("correct", F.lit(0)).alias("correct"))


def _with_combo_columns(df: DataFrame, combos: list[dict], extra: list[str] | None = None) -> DataFrame:
    names = [n for n in combos[0] if extra is None or n in extra]
    table = df.sparkSession.createDataFrame(pd.DataFrame(
        [{"combo": i, **{n: c[n] for n in names}} for i, c in enumerate(combos)]))
    return df.join(F.broadcast(table.withColumn("combo", F.col("combo").cast("int"))), "combo")


def labelled_candidates(feats: DataFrame, labels: DataFrame, both_unreadable: bool = False, single: bool | None = None) -> DataFrame:
    """Candidates of labelled images with ``is_correct`` against the label (string or readable date).

    ``both_unreadable`` is the rule of the whole pipeline, where two values that are no dates match too. ``single`` tells whether
    every image is one tile where that is known; else the features are read for it.
    """
    key = lambda c: F.expr(final_date_sql(c))
    lab = last_per_id(labels).select("image_id", F.col("final_date").alias("target"), key("final_date").alias("target_key"))
    shown = candidate_final_date(F.col("year"), F.col("month"), F.col("day"), F.col("calendar_valid"), "NONE", "NONE")
    c = feats.withColumns({"predicted": F.coalesce(shown, F.lit("NONE")), "o1": F.lit(0), "o2": F.lit(0.0),
                           "o3": F.col("cand_ordinal"), "tile": S.candidate_tile(F.col("cand_ordinal"))})
    own = F.when(F.col("calendar_valid"), F.struct("year", "month", "day"))
    neither = own.isNull() & F.col("target_key").isNull() if both_unreadable else F.lit(False)
    single = in_one_tile(c, "tile") if single is None else single
    return join_by_tile(c, lab, "image_id", "tile", single=single).withColumn(
        "is_correct", (F.col("predicted") == F.col("target")) | neither
        | F.coalesce(own.eqNullSafe(F.col("target_key")) & F.col("target_key").isNotNull(), F.lit(False)))


_EVALUATED = ["image_id", "tile", "last_tile", "o1", "o2", "o3", "is_correct", *S.FEATURE_COLUMNS]


def _labelled_images(labels: DataFrame, image_ids: DataFrame) -> DataFrame:
    """The images evaluated: their labels, and whether these are readable."""
    return last_per_id(labels).join(image_ids.select("image_id").distinct(), "image_id", "left_semi").select(
        "image_id", "final_date", F.expr(final_date_sql("final_date")).isNotNull().alias("readable"))


def _label_counts(labels: DataFrame, cands: DataFrame, image_ids: DataFrame, both_unreadable: bool = False,
                  best: list[Column] = (), also: dict[str, Column] = {}) -> DataFrame:
    """One row: images evaluated, readable targets, covered targets, images without any candidate.

    ``best`` are further aggregates of an image's candidates, ``also`` further aggregates over the images.
    """
    lab = _labelled_images(labels, image_ids)
    per = cands.groupBy("image_id").agg(F.max("is_correct").alias("hit"), *best)
    j = lab.join(per, "image_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    empty = F.col("hit").isNull()
    return j.agg(F.count("*").alias("total_images"), n(F.col("readable")).alias("targets"),
                 n(F.col("readable") & F.coalesce("hit", F.lit(False))).alias("covered"), n(empty).alias("none_predictions"),
                 n(empty & ((F.col("final_date") == "NONE") | (~F.col("readable") if both_unreadable else F.lit(False)))).alias("right_without"),
                 *[v.alias(name) for name, v in also.items()])


def grid_search(feats: DataFrame, labels: DataFrame, images: DataFrame, grid: dict[str, list] | None = None,
                max_combinations: int | None = None) -> DataFrame:
    """Exact match, recall, selection and NONE rate of every weight set, best first.

    All weight sets of the grid are tried; ``max_combinations`` takes evenly spaced ones instead. ``images`` are the ids of the token table; images without candidates predict NONE whatever the
    weights. Selection accuracy is correct / covered and can exceed 1.
    """
    combos = product_grid(grid or DEFAULT_GRID, max_combinations, strided=True)
    base = S.ScoreParams()
    full = [{**{n: getattr(base, n) for n in S.WEIGHT_NAMES}, **c} for c in combos]
    cands = labelled_candidates(feats, labels)
    counts = F.broadcast(_label_counts(labels, cands, images))      # one row
    out = count_correct(cands, S.FEATURE_COLUMNS, full).crossJoin(counts)
    correct = F.col("correct") + F.col("right_without")
    div = lambda a, b: F.coalesce(F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), 4), F.lit(0.0))
    out = out.select("combo", div(correct, F.col("total_images")).alias("final_date_exact_match"),
                     div(F.col("covered"), F.col("targets")).alias("candidate_recall"),
                     div(correct, F.col("covered")).alias("candidate_selection_accuracy"),
                     correct.alias("correct_count"), "total_images",
                     div(F.col("none_predictions"), F.col("total_images")).alias("none_rate"))
    return _with_combo_columns(out, combos).orderBy(
        F.desc("final_date_exact_match"), F.desc("candidate_selection_accuracy"), "combo")


def _parser_features(tokens: DataFrame, pairs: list[tuple[bool, bool]], store):
    """Features by pair of parser flags. Several pairs share one annotated extraction; a single one needs no annotation."""
    if len(pairs) == 1:
        cands = extract_candidates(tokens, *pairs[0], materialise=store, by_text=True)
        return lambda day_first, month_names: store(S.features(cands, tokens))
    annotated = annotated_candidates(tokens, materialise=store)
    return lambda day_first, month_names: store(S.features(candidates_under(annotated, day_first, month_names), tokens))


def _place(score: Column, *order: str) -> Column:
    """An array whose maximum is the best candidate: score, then the order columns (first wins), last ``is_correct``.

    Arrays of doubles are copied as one piece, structs field by field; ordinals are below 2 ** 52, so they are exact.
    """
    return F.array(score, *[-F.col(o).cast("double") for o in order], F.col("is_correct").cast("double"))


def _right_places(best: str) -> Column:
    return F.sum(F.element_at(best, -1).cast("int"))


def _few_params(tokens: DataFrame, labels: DataFrame, groups: dict[tuple[bool, bool], list[int]], combos: list[dict], annotated: DataFrame,
                both_unreadable: bool, images: DataFrame) -> DataFrame:
    """``evaluate_params`` for few weight sets, from one shuffle of the candidates under all settings of the parser.

    One aggregate by image keeps the best candidate under every weight set, behind the features and in their partitions.
    """
    # lines take part by the first tile only
    one_tile = in_one_tile(tokens, tile_of(F.col("token_index")))
    cands, places = candidates_with_places(annotated, list(groups))
    feats = S.features(cands, tokens, places=places, one_tile=one_tile)
    rows = labelled_candidates(feats, labels, both_unreadable, single=one_tile).withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    suffix_of = {i: s for s, indexes in zip(places, groups.values()) for i in indexes}
    score = lambda i: _linear_score(combos[i], {
        n: F.col(n + suffix_of[i] if n in S.SETTING_FEATURES else n).cast("double") for n in S.FEATURE_COLUMNS})
    # scores stand inside the aggregate, which compiles them one by one; a projection of all is too long a method for the JVM to compile
    per = rows.groupBy("image_id").agg(
        *[F.max(F.when(F.col(place).isNotNull(), F.col("is_correct"))).alias(f"hit{s}") for s, place in places.items()],
        *[F.max(F.when(F.col(places[s]).isNotNull(), _place(score(i), places[s]))).alias(f"best{i}") for i, s in suffix_of.items()])
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    unread = (F.col("final_date") == "NONE") | (~F.col("readable") if both_unreadable else F.lit(False))
    counts = _labelled_images(labels, images).join(per, "image_id", "left").agg(
        F.count("*").alias("total"), n(F.col("readable")).alias("targets"),
        *[v for s in places for v in (n(F.col("readable") & F.coalesce(f"hit{s}", F.lit(False))).alias(f"covered{s}"),
                                      n(F.col(f"hit{s}").isNull() & unread).alias(f"without{s}"))],
        *[F.coalesce(_right_places(f"best{i}"), F.lit(0)).alias(f"right{i}") for i in suffix_of])
    each = F.array(*[F.struct(F.lit(i).alias("combo"), (F.col(f"right{i}") + F.col(f"without{s}")).alias("correct"), "total", "targets",
                              F.col(f"covered{s}").alias("covered")) for i, s in suffix_of.items()])
    return counts.select(F.explode(each).alias("e")).select("e.*")


def evaluate_params(tokens: DataFrame, labels: DataFrame, params: list[dict], store=materialise,
                    features_for=None, both_unreadable: bool = False, images: DataFrame | None = None,
                    annotated: DataFrame | None = None) -> DataFrame:
    """Exact match of parameter sets that may also differ in parser flags.

    ``images`` has the ids of all images, those without tokens too; by default the tokens' own.

    The grammar runs once for all pairs of parser flags (``annotated``, where it is there already). Few weight sets are evaluated together.
    For many, features are computed once per distinct pair (four at most), and all weight sets of a pair share them.
    """
    base = S.ScoreParams()
    groups: dict[tuple[bool, bool], list[int]] = {}
    for i, p in enumerate(params):
        groups.setdefault((bool(p.get("allow_day_first", False)), bool(p.get("allow_month_names", False))), []).append(i)
    if len(params) <= FEW_SETS:
        weights = [{n: float(p.get(n, getattr(base, n))) for n in S.WEIGHT_NAMES} for p in params]
        annotated = annotated_candidates(tokens, materialise=store) if annotated is None else annotated
        return _few_params(tokens, labels, groups, weights, annotated, both_unreadable, tokens if images is None else images)
    make = features_for or _parser_features(tokens, list(groups), store)
    out = None
    for (day_first, month_names), indexes in groups.items():
        combos = [{n: params[i].get(n, getattr(base, n)) for n in S.WEIGHT_NAMES} for i in indexes]
        cands = store(labelled_candidates(make(day_first, month_names), labels, both_unreadable).select(*_EVALUATED))
        counts = F.broadcast(_label_counts(labels, cands, tokens if images is None else images, both_unreadable))
        number = F.element_at(F.array(*[F.lit(i) for i in indexes]), F.col("combo") + 1)
        part = count_correct(cands, S.FEATURE_COLUMNS, combos).crossJoin(counts).select(
            number.alias("combo"), (F.col("correct") + F.col("right_without")).alias("correct"),
            F.col("total_images").alias("total"), "targets", "covered")
        out = part if out is None else out.unionByName(part)
    return out


def stage_ablation(tokens: DataFrame, labels: DataFrame, store=materialise, annotated: DataFrame | None = None) -> DataFrame:
    """The ten cumulative stages with gain over the stage before and a keep/prune decision."""
    stages = ablation_stages()
    r = evaluate_params(tokens, labels, [p for _, p in stages], store, annotated=annotated)
    em = F.coalesce(F.round(F.col("correct") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 4), F.lit(0.0))
    names = F.array(*[F.lit(n) for n, _ in stages])
    r = r.select("combo", F.element_at(names, F.col("combo") + 1).alias("stage"), em.alias("exact_match"),
                 "correct", "total")
    before = F.lag("exact_match").over(Window.orderBy("combo"))       # ten rows
    delta = F.coalesce(F.col("exact_match") - before, F.lit(0.0))
    return (r.withColumn("__d", delta)
            .withColumn("decision", F.when((F.col("combo") == 0) | (F.col("__d") >= 0.005), "KEEP")
                        .when(F.col("__d") == 0.0, "NEUTRAL").otherwise("PRUNE"))
            .withColumn("delta_em", F.round("__d", 4)).drop("__d", "combo"))


def cartesian_ablation(tokens: DataFrame, labels: DataFrame, grid: dict[str, list], max_runs: int | None = None,
                       store=materialise, features_for=None, annotated: DataFrame | None = None) -> DataFrame:
    """All combinations of a grid over weights and parser flags (or the first ``max_runs``), with their metrics."""
    combos = product_grid({k: v if isinstance(v, list) else [v] for k, v in grid.items()}, max_runs)
    flat = [{k.rsplit(".", 1)[-1]: v for k, v in c.items()} for c in combos]
    div = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    r = evaluate_params(tokens, labels, flat, store, features_for, both_unreadable=True, annotated=annotated).select(
        "combo", F.format_string("run_%03d", F.col("combo") + 1).alias("run"),
        div("correct", "total").alias("final_date_exact_match"), div("covered", "targets").alias("candidate_recall"),
        div("correct", "covered").alias("candidate_selection_accuracy"), F.col("total").alias("labeled_count"))
    return _with_combo_columns(r, flat).drop("combo")


def source_multiplier_sweep(tokens: DataFrame, labels: DataFrame, source: str, params: S.ScoreParams = S.ScoreParams(),
                            multipliers: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), store=materialise) -> DataFrame:
    """Exact match with the confidence of one token source scaled down step by step.

    Confidence does not influence extraction, so candidates and features are computed once with
    both the plain mean confidence and the share of it that belongs to the source. One aggregate by image, behind the
    features without another shuffle of them, keeps the best candidate under each multiplier.
    """
    cands = extract_candidates(tokens, params.allow_day_first, params.allow_month_names, materialise=store, by_text=True)
    one_tile = in_one_tile(cands, S.candidate_tile(F.col("cand_ordinal")))
    feats = S.features(_with_source_part(cands, tokens, source), tokens, params)
    labelled = labelled_candidates(feats, labels, both_unreadable=True, single=one_tile)
    plain, weights = F.col("recognition_confidence"), lambda name: F.lit(float(getattr(params, name)))
    for j, m in enumerate(multipliers):       # score_column reads the confidence by its name
        labelled = (labelled.withColumn("recognition_confidence", F.col("__plain") - F.col("part") * (1 - m)) if j else
                    labelled.withColumn("__plain", plain).withColumn("recognition_confidence", plain - F.col("part") * (1 - m)))
        labelled = labelled.withColumn(f"__place{j}", F.struct(S.score_column(weights).alias("score"), (-F.col("cand_ordinal")).alias("o"),
                                                               F.col("is_correct").cast("int").alias("right")))
    best = [F.max(f"__place{j}").alias(f"best{j}") for j in range(len(multipliers))]
    right = [F.coalesce(F.sum(f"best{j}.right"), F.lit(0)) for j in range(len(multipliers))]
    counts = _label_counts(labels, labelled, tokens, both_unreadable=True, best=best, also={f"right{j}": r for j, r in enumerate(right)})
    each = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"right{j}").alias("correct")) for j, m in enumerate(multipliers)])
    every = counts.withColumn("each", F.explode(each)).select("*", "each.*")
    return every.select(
        "multiplier", ((F.col("correct") + F.col("right_without")) / F.col("total_images")).alias("final_em"),
        (F.col("covered") / F.nullif(F.col("targets").cast("double"), F.lit(0.0))).alias("candidate_recall"),
        ((F.col("correct") + F.col("right_without")) / F.nullif(F.col("covered").cast("double"), F.lit(0.0))).alias("selection_accuracy"))


def _with_source_part(cands: DataFrame, tokens: DataFrame, source: str) -> DataFrame:
    """Candidates with ``part``, the share of their mean confidence that tokens of the source have. ``cands`` should be a stored table.

    A candidate of one token has that token's confidence; only those of joined lines ask the tokens.
    """
    own = F.greatest(F.col("recognition_confidence"), F.lit(0.0))
    plain = cands.filter(~F.col("joined")).withColumn("part", F.when(F.get("sources", F.lit(0)).eqNullSafe(source), own).otherwise(0.0))
    lines = cands.filter("joined")
    if lines.isEmpty():
        return plain
    conf = tokens.filter((F.col("confidence") > 0) & F.col("source").eqNullSafe(source)).select(
        "image_id", F.col("token_index").alias("i"), F.col("confidence").alias("v"))
    part = (lines.select("image_id", "cand_ordinal", F.explode("token_indices").alias("i"), F.size("token_indices").alias("n"))
            .join(conf, ["image_id", "i"]).groupBy("image_id", "cand_ordinal").agg(F.sum(F.col("v") / F.col("n")).alias("part")))
    return plain.unionByName(lines.join(part, ["image_id", "cand_ordinal"], "left").withColumn("part", F.coalesce("part", F.lit(0.0))))


# --- fits over a pool of both sources ------------------------------------------------------------

def union_pool(baseline: DataFrame, detector: DataFrame, single: bool | None = None) -> DataFrame:
    """Baseline candidates (by rank) and detector candidates (by position) of an image as one pool.

    o1, o2, o3 give the pool order: baseline first, by score descending and generation order. ``single`` tells whether every image is
    one tile where that is known; else both are read for it and should be stored tables.
    """
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-6)))
    cols = ["image_id", "prediction", "source", "score", "rec", "det", "class", "bbox"]
    b = baseline.select(*cols, F.lit(0).alias("o1"), (-F.col("score")).alias("o2"), F.col("cand_ordinal").alias("o3"))
    y = detector.select(*cols, F.lit(1).alias("o1"), F.lit(0.0).alias("o2"), F.col("candidate_index").cast("long").alias("o3"))
    index = F.when(F.col("o1") == 0, S.candidate_tile(F.col("o3"))).otherwise(S.tile_of(F.col("o3")))
    pool = b.unionByName(y).withColumns({
        "is_yolo": F.col("source") == "yolo", "is_due": F.col("class") == 1, "log_rec": log("rec"), "log_det": log("det"),
        "tile": index})
    if in_one_tile(pool, "tile") if single is None else single:
        return pool.withColumn("last_tile", F.lit(0))
    last = pool.groupBy("image_id").agg(F.max("tile").alias("last_tile"))
    return pool.join(last, "image_id")


def pool_spatial(pool: DataFrame, stored: DataFrame | None = None, single: bool | None = None) -> DataFrame:
    """Add ``spatial``: best IoU with a box of the other source.

    ``stored`` is a pool of the same boxes that reads stored tables only, and ``single`` tells whether every image is one tile where that is
    known; see ``other_source_iou``.
    """
    keyed = lambda p: p.withColumns({
        "sources": F.array("source"), "union_box": F.col("bbox"),
        "cand_ordinal": F.when(F.col("o1") == 0, F.col("o3")).otherwise(F.col("o3") * S.ORDINAL_STRIDE)}).drop("tile")
    return S.other_source_iou(keyed(pool), None if stored is None else keyed(stored), single).withColumn(
        "tile", S.candidate_tile(F.col("cand_ordinal"))).drop("sources", "union_box", "cand_ordinal")


def _evaluate_fit(pool: DataFrame, labels: DataFrame, combos: list[dict], features: list[str], score) -> DataFrame:
    lab = last_per_id(labels).select("image_id", F.col("final_date").alias("target"))
    c = join_by_tile(pool, lab, "image_id", "tile", single=in_one_tile(pool, "tile")).withColumn("is_correct", F.coalesce(F.col("prediction") == F.col("target"), F.lit(False)))
    found = F.broadcast(c.filter("is_correct").select("image_id").distinct().agg(F.count("*").alias("found"))
                        .crossJoin(F.broadcast(labels.agg(F.count("*").alias("images")))))
    one = lambda x: F.greatest(F.lit(1), F.col(x))
    return count_correct(c, features, combos, score).crossJoin(found).select(
        "combo", "images", (F.col("found") / one("images")).alias("candidate_recall"),
        (F.col("correct") / one("images")).alias("final_em"), (F.col("correct") / one("found")).alias("selection_accuracy"))


def _evaluate_few(pool: DataFrame, labels: dict[str, DataFrame], combos: list[dict], features: list[str], score, single: bool | None) -> DataFrame:
    """``_evaluate_fit`` for few weight sets and the labels of several splits, from one pass over the pool: (split, combo, ...).

    One aggregate by image and split keeps the best candidate under every weight set.
    """
    name = lambda df, split: df.withColumn("split", F.lit(split))
    both = lambda dfs: reduce(DataFrame.unionByName, dfs)
    lab = both([name(last_per_id(df).select("image_id", F.col("final_date").alias("target")), split) for split, df in labels.items()])
    single = in_one_tile(pool, "tile") if single is None else single
    c = join_by_tile(pool, lab, "image_id", "tile", single=single).withColumn("is_correct", F.coalesce(F.col("prediction") == F.col("target"), F.lit(False)))
    f = {n: F.col(n).cast("double") for n in features}
    where = lambda test, a, b: F.when(test, a).otherwise(b)
    per = c.groupBy("image_id", "split").agg(F.max("is_correct").alias("hit"), *[
        F.max(_place(score(w, f, where), "o1", "o2", "o3")).alias(f"best{i}") for i, w in enumerate(combos)])
    sums = per.groupBy("split").agg(F.sum(F.col("hit").cast("int")).alias("found"), *[_right_places(f"best{i}").alias(f"right{i}") for i in range(len(combos))])
    images = both([name(df.agg(F.count("*").alias("images")), split) for split, df in labels.items()])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.coalesce(f"right{i}", F.lit(0)).alias("correct")) for i in range(len(combos))]))
    one = lambda x: F.greatest(F.lit(1), F.col(x))
    return images.join(F.broadcast(sums), "split", "left").select("split", "images", F.coalesce("found", F.lit(0)).alias("found"), each.alias("e")).select(
        "split", "e.combo", "images", (F.col("found") / one("images")).alias("candidate_recall"),
        (F.col("e.correct") / one("images")).alias("final_em"), (F.col("e.correct") / one("found")).alias("selection_accuracy"))


_FITS = {"source": (["is_yolo", "score", "log_rec", "log_det", "is_due"], _source_score, SOURCE_GRID),
         "spatial": (["is_yolo", "score", "log_rec", "log_det", "spatial"], _spatial_score, SPATIAL_GRID)}


def fit_weights(kind: str, train_pool: DataFrame, train_labels: DataFrame, val_pool: DataFrame | None = None,
                val_labels: DataFrame | None = None, grid: dict[str, list] | None = None, single: bool | None = None) -> DataFrame:
    """Best weights by (exact match, selection, recall) on train, the first on ties, and their
    report on train and validation: one row per split.

    What the weight sets reach is a small table, stored, so that a pool is evaluated once; few weight sets share one pass over a pool
    that both splits have. ``single`` tells whether every image of the pools is one tile where that is known.
    """
    names, score, default = _FITS[kind]
    combos = product_grid(grid or default)
    splits = {"train": (train_pool, train_labels)} | ({} if val_pool is None else {"val": (val_pool, val_labels)})
    if len(combos) <= FEW_SETS:
        shared = val_pool is None or val_pool is train_pool
        passes = [(train_pool, {s: lab for s, (_, lab) in splits.items()})] if shared else [(p, {s: lab}) for s, (p, lab) in splits.items()]
        every = [materialise(_evaluate_few(p, labs, combos, names, score, single)) for p, labs in passes]
        reached = {s: reduce(DataFrame.unionByName, every).filter(F.col("split") == s).drop("split") for s in splits}
    else:
        reached = {s: materialise(_evaluate_fit(p, lab, combos, names, score)) for s, (p, lab) in splits.items()}
    train = reached["train"]
    best = train.orderBy(F.desc("final_em"), F.desc("selection_accuracy"), F.desc("candidate_recall"), "combo").limit(1)
    out = best.withColumn("split", F.lit("train"))
    if val_pool is not None:
        out = out.unionByName(reached["val"].join(F.broadcast(best.select("combo")), "combo", "left_semi").withColumn("split", F.lit("val")))
    return _with_combo_columns(out, combos).drop("combo")
