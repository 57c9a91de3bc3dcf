"""Scoring, ranking and selecting date candidates.

Scoring needs facts about the whole image: its keyword tokens and its earliest and latest
complete date. Both are aggregated with map-side combining, keywords in blocks of bounded size,
and then joined to the candidates by (image, tile). No step pairs the rows of an image with each
other, and an image with very many tokens is spread over its tiles.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.functions.dates import DEFAULT_RELIABILITY, PATTERNS, candidate_final_date
from expirylens.functions.geometry import aspect_ratio, box_iou, spatial_relation
from expirylens.functions.text import contains_any
from expirylens.operators.box_grid import BOXES_PER_CELL, meet_boxes
from expirylens.operators.ordering import in_one_tile, join_by_tile, rank_in_groups, top_per_group
from expirylens.plans.storage import materialise
from expirylens.schemas import ORDINAL_STRIDE, tile_of

# Keyword lists, matched as lower-case substrings.
POSITIVE_KEYWORDS = ("소비기한", "유통기한", "품질유지기한", "exp", "expiry", "exp date", "best before",
                     "use by", "bbe", "bb", "까지")
NEGATIVE_KEYWORDS = ("제조일", "제조일자", "제조", "mfg", "mfd", "prod", "lot", "부터")

# The two adjustments for day-first dates.
DMY_WITHOUT_SLASH, DMY_WITH_SLASH, DMY_SLASH_LAST_YEAR = -0.6, 0.4, 2026

KEYWORDS_PER_BLOCK = 1024
FEW_BOXES = 8


@dataclass(frozen=True)
class ScoreParams:
    """Weights of the keyword_regex selector (fixed default values)."""
    keyword_weight: float = 0.7
    negative_keyword_weight: float = 0.45
    confidence_weight: float = 0.2
    detection_confidence_weight: float = 0.2
    calendar_weight: float = 0.5
    pattern_weight: float = 0.25
    position_weight: float = 0.25
    same_line_bonus: float = 0.15
    partial_date_penalty: float = 0.45
    time_like_penalty: float = 0.60
    future_date_bonus: float = 0.15
    keep_invalid: bool = False
    allow_day_first: bool = False
    allow_month_names: bool = False
    sanitization_mode: str = "none"
    source_confidence_multipliers: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class UnionParams(ScoreParams):
    """Weights of the union_spatial selector (fixed default values)."""
    yolo_bonus: float = 1.5
    candidate_score_weight: float = 1.5
    recognition_log_weight: float = 1.5
    detection_log_weight: float = 0.5
    bbox_iou_weight: float = 0.5


WEIGHT_NAMES = ("keyword_weight", "negative_keyword_weight", "confidence_weight",
                "detection_confidence_weight", "calendar_weight", "pattern_weight", "position_weight",
                "partial_date_penalty", "time_like_penalty", "future_date_bonus")


def with_overrides(params: ScoreParams, **overrides) -> ScoreParams:
    """Copy with overrides, each a bare name or a path of the configuration (``selector.params.keyword_weight``).

    A name below any other path is unknown.
    """
    names = {f.name for f in fields(params)}
    flat = {k.removeprefix("selector.").removeprefix("params.") if k.startswith(("selector.params.", "params.")) else k: v
            for k, v in overrides.items()}
    unknown = set(flat) - names
    if unknown:
        raise ValueError(f"Unknown parameters {sorted(unknown)}; available: {sorted(names)}")
    return replace(params, **flat)


# --- small column expressions --------------------------------------------------------------------

def pattern_reliability(pattern: Column) -> Column:
    out = F.lit(None).cast("double")
    for p in PATTERNS:
        out = F.when(pattern == p.name, p.reliability).otherwise(out) if p is not PATTERNS[0] else \
            F.when(pattern == p.name, p.reliability)
    return F.coalesce(out, F.lit(DEFAULT_RELIABILITY))


def source_prior(sources: Column, multipliers: dict[str, float]) -> Column:
    """Mean multiplier of the candidate's token sources; unknown sources count 1."""
    if not multipliers:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(v) for kv in multipliers.items() for v in kv])
    each = F.transform(sources, lambda s: F.coalesce(
        F.try_element_at(table, F.coalesce(s, F.lit(""))), F.lit(1.0)))
    return F.when(F.size(sources) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
                  / F.size(sources)).otherwise(F.lit(1.0))


def candidate_source(sources: Column) -> Column:
    """``yolo`` when any token source starts with it; a missing source counts as baseline."""
    return F.when(F.exists(sources, lambda s: F.coalesce(s, F.lit("baseline")).startswith("yolo")),
                  F.lit("yolo")).otherwise(F.lit("baseline"))


def is_positive(text: Column) -> Column:
    return contains_any(F.lower(text), POSITIVE_KEYWORDS)


def is_negative(text: Column) -> Column:
    return contains_any(F.lower(text), NEGATIVE_KEYWORDS)


def candidate_tile(ordinal: Column) -> Column:
    return tile_of(F.floor(ordinal / F.lit(ORDINAL_STRIDE)))


def _date(c: DataFrame | None = None) -> Column:
    return F.concat_ws("-", "year", "month", "day").try_cast("date")


# --- facts about an image ------------------------------------------------------------------------

def keyword_blocks(tokens: DataFrame) -> DataFrame:
    """Keyword tokens of an image in arrays of at most KEYWORDS_PER_BLOCK entries."""
    text = F.col("text")      # no keyword begins or ends with white space, so the text needs no trim
    kw = (tokens.select("image_id", "token_index", "bbox", is_positive(text).alias("pos"),
                        is_negative(text).alias("neg"))
          .filter(F.col("pos") | F.col("neg")))
    return (kw.groupBy("image_id", F.floor(F.col("token_index") / KEYWORDS_PER_BLOCK).alias("block"))
            .agg(F.collect_list(F.struct("token_index", "bbox", "pos", "neg")).alias("kws")))


# Candidates under one setting of the parser: what depends on the setting has no suffix, and places are ordinals.
ONE_SETTING = {"": "cand_ordinal"}


def _date_of_text(place: str) -> tuple[Column, Column]:
    """Aggregates over the rows of a raw text: its last ``ymd*`` reading in ``d``, and its first reading, by their places."""
    dated = F.col("d").isNotNull()
    return (F.max_by("d", F.when(dated & F.col("pattern").startswith("ymd"), F.col(place))),
            F.min_by("d", F.when(dated, F.col(place))))


def _complete_date() -> Column:
    return F.when(F.col("calendar_valid") & F.col("year").isNotNull() & F.col("day").isNotNull(), _date())


def date_extremes(cands: DataFrame, places: dict[str, str] = ONE_SETTING) -> DataFrame:
    """Per image: earliest and latest complete date, the tiles that hold candidates, and the last of them.

    A raw text counts once: its last ``ymd*`` reading, otherwise its first reading. Both levels
    combine on the map side. ``places``: see ``features``.
    """
    per_text = (cands.select("image_id", "raw_text", "cand_ordinal", "pattern", *{p for p in places.values() if p != "cand_ordinal"},
                             _complete_date().alias("d"))
                .groupBy("image_id", "raw_text").agg(
                    *[F.coalesce(*_date_of_text(place)).alias(f"text_date{s}") for s, place in places.items()],
                    F.collect_set(candidate_tile(F.col("cand_ordinal"))).alias("tiles")))
    return per_text.groupBy("image_id").agg(
        *[f(f"text_date{s}").alias(f"{name}{s}") for s in places for f, name in ((F.min, "min_date"), (F.max, "max_date"))],
        F.array_distinct(F.flatten(F.collect_list("tiles"))).alias("tiles")).withColumn("last_tile", F.array_max("tiles"))


def spread_over_tiles(per_image: DataFrame) -> DataFrame:
    """Copy per-image rows to every tile of the image that holds candidates (one for all but huge images)."""
    return per_image.withColumn("tile", F.explode("tiles")).drop("tiles")


def with_date_extremes(cands: DataFrame, places: dict[str, str] = ONE_SETTING, one_tile: bool | None = None) -> tuple[DataFrame, list[str]]:
    """Candidates with the extremes of ``date_extremes`` and their tile, and the keys that they are partitioned by.

    The candidates are shuffled once, by image, and both levels are windows over the sorted rows. Only where an image has
    several tiles, the candidates go by (image, tile), and the extremes of such images come from aggregates. ``one_tile`` is given
    where that is known already; else the candidates are read for it.
    """
    c = cands.withColumn("tile", candidate_tile(F.col("cand_ordinal")))
    large = c.filter(F.col("tile") != 0).select("image_id").distinct()
    one_tile = large.isEmpty() if one_tile is None else one_tile
    keys = ["image_id"] if one_tile else ["image_id", "tile"]
    of_text, of_image = Window.partitionBy(*keys, "raw_text"), Window.partitionBy(*keys)
    names = [f"{name}{s}" for s in places for name in ("min_date", "max_date")] + ["last_tile"]
    c = (c.repartition(*keys).withColumn("d", _complete_date())
         .withColumns({f"__t{s}": F.coalesce(*[v.over(of_text) for v in _date_of_text(place)]) for s, place in places.items()})
         .withColumns({f"{name}{s}": f(f"__t{s}").over(of_image) for s in places for f, name in ((F.min, "min_date"), (F.max, "max_date"))})
         .withColumn("last_tile", F.lit(0)).drop("d", *[f"__t{s}" for s in places]))
    if one_tile:
        return c, keys
    large = materialise(large)
    facts = spread_over_tiles(date_extremes(cands.join(large, "image_id", "left_semi"), places)).select(
        *keys, *[F.col(n).alias(f"__{n}") for n in names])
    own = F.col("__last_tile").isNotNull()
    return (c.join(facts, keys, "left").withColumns({n: F.when(own, F.col(f"__{n}")).otherwise(F.col(n)) for n in names})
            .drop(*[f"__{n}" for n in names])), keys


def context_features(cands: DataFrame, tokens: DataFrame, same_line_bonus: float = 0.15,
                     extremes: DataFrame | None = None, places: dict[str, str] = ONE_SETTING, one_tile: bool | None = None) -> DataFrame:
    """Add positive, negative and spatial keyword evidence, and the image's date extremes.

    Positive and negative evidence is the best of closeness in reading order plus spatial
    relation; each feature is capped at 1.5. A candidate's own token counts as well.
    """
    blocks = materialise(keyword_blocks(tokens))
    one_block = blocks.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if extremes is None:
        c, keys = with_date_extremes(cands, places, one_tile)
        kws = blocks.select("image_id", "kws")
        joined = c.join(kws, "image_id", "left") if keys == ["image_id"] else join_by_tile(c, kws, "image_id", "tile", "left")
    else:
        facts = spread_over_tiles(extremes.join(blocks.select("image_id", "kws"), "image_id", "left"))
        joined = cands.withColumn("tile", candidate_tile(F.col("cand_ordinal"))).join(facts, ["image_id", "tile"], "left")
    columns = [*cands.columns, "tile", *[f"{name}{s}" for s in places for name in ("min_date", "max_date")], "last_tile"]

    def near(k: Column) -> Column:
        return 1.0 / (1.0 + F.abs(k.token_index - F.col("first_index")))

    def rel(k: Column) -> Column:
        return spatial_relation(k.bbox, F.col("first_box"), same_line_bonus)
    # an image with one keyword needs no array functions, which Spark does not compile
    alone, k = F.size("kws") == 1, F.get("kws", F.lit(0))
    seen = joined.select(*columns, "kws", alone.alias("__alone"), k.alias("__k"),
                         F.when(alone, near(k)).alias("__near"), F.when(alone, rel(k)).alias("__rel"),
                         F.when(~alone, F.transform("kws", lambda k: F.struct(
                             k.pos.alias("pos"), k.neg.alias("neg"), near(k).alias("near"), rel(k).alias("rel")))).alias("seen"))

    def best(flag: str) -> Column:
        return F.when(F.col("__alone"), F.when(F.col(f"__k.{flag}"), F.col("__near") + F.col("__rel"))).otherwise(
            F.array_max(F.transform(F.filter("seen", lambda k: k[flag]), lambda k: k.near + k.rel)))
    s = F.when(F.col("__alone"), F.col("__rel")).otherwise(F.array_max(F.transform("seen", lambda k: k.rel)))
    scored = seen.select(*columns, best("pos").alias("p"), best("neg").alias("n"), s.alias("s"))
    cap = lambda x: F.least(F.lit(1.5), F.coalesce(x, F.lit(0.0)))
    evidence = {"positive_keyword": "p", "negative_keyword": "n", "spatial_relation": "s"}
    if one_block:
        return scored.select(*columns, *[cap(F.col(v)).alias(name) for name, v in evidence.items()]).drop("tile")
    # more than one block only in images with very many keywords
    keys = ("image_id", "tile", "cand_ordinal", *[p for p in places.values() if p != "cand_ordinal"])
    return per_candidate(scored, columns, {name: cap(F.max(v)) for name, v in evidence.items()}, keys).drop("tile")


def per_candidate(rows: DataFrame, columns: list[str], values: dict[str, Column],
                  keys: tuple[str, ...] = ("image_id", "tile", "cand_ordinal")) -> DataFrame:
    """Aggregates per candidate; its other columns, arrays and structs among them, are carried along, not compared."""
    rest = [n for n in columns if n not in keys]
    return (rows.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("__c"), *[v.alias(n) for n, v in values.items()])
            .select(*[n if n in keys else F.col(f"__c.{n}").alias(n) for n in columns], *values))


def features(cands: DataFrame, tokens: DataFrame, params: ScoreParams = ScoreParams(), places: dict[str, str] = ONE_SETTING,
             one_tile: bool | None = None) -> DataFrame:
    """The scoring features of every candidate as flat columns.

    A table may hold the candidates under several settings of the parser, each row once (see ``candidates_with_places``). Then ``places``
    names for each setting a suffix and the column of the ordinals under it, null where it has no such candidate, and the
    features that depend on the setting are there once for each, with its suffix. ``one_tile``: see ``with_date_extremes``.
    """
    f = context_features(cands, tokens, params.same_line_bonus, places=places, one_tile=one_tile)
    d = _date()
    complete = F.col("year").isNotNull() & F.col("month").isNotNull() & F.col("day").isNotNull()

    def of_setting(s: str) -> dict[str, Column]:
        first, last = F.col(f"min_date{s}"), F.col(f"max_date{s}")
        later = F.coalesce((last > first) & complete & (d == last), F.lit(False))
        return {f"is_partial{s}": last.isNotNull() & F.col("year").isNull(), f"has_many_dates{s}": F.coalesce(last > first, F.lit(False)),
                f"is_latest{s}": later,
                f"is_earliest_bare{s}": F.coalesce((last > first) & complete & (d == first), F.lit(False)) & ~later
                & (F.col("positive_keyword") == 0)}
    slash = F.col("raw_text").contains("/")
    dmy = (F.when((F.col("pattern") == "dmy_separated") & ~slash, DMY_WITHOUT_SLASH)
           .when((F.col("pattern") == "dmy_separated")
                 & (F.coalesce(F.col("year").cast("int"), F.lit(0)) <= DMY_SLASH_LAST_YEAR), DMY_WITH_SLASH)
           .otherwise(0.0))
    return f.withColumns({
        "source_prior": source_prior(F.col("sources"), params.source_confidence_multipliers),
        "pattern_reliability": pattern_reliability(F.col("pattern")),
        "calendar": F.when(F.col("calendar_valid"), 1.0).otherwise(-1.0),
        "is_time_like": F.col("raw_text").rlike(r"^\d{1,2}:\d{2}$"),
        **{name: value for s in places for name, value in of_setting(s).items()},
        "dmy_adjustment": dmy,
    }).drop(*[f"{name}{s}" for s in places for name in ("min_date", "max_date")])


FEATURE_COLUMNS = ["recognition_confidence", "detection_confidence", "source_prior", "pattern_reliability",
                   "calendar", "positive_keyword", "negative_keyword", "spatial_relation", "is_partial",
                   "is_time_like", "is_latest", "is_earliest_bare", "dmy_adjustment"]
# Those that depend on the setting of the parser.
SETTING_FEATURES = ("is_partial", "is_latest", "is_earliest_bare")


def score_column(weights) -> Column:
    """Linear score over the feature columns; ``weights(name)`` gives a column per weight."""
    w, c = weights, F.col
    rec = c("recognition_confidence") * c("source_prior")
    total = (w("confidence_weight") * rec
             + w("detection_confidence_weight") * c("detection_confidence")
             + w("calendar_weight") * c("calendar")
             + w("pattern_weight") * c("pattern_reliability")
             + w("keyword_weight") * c("positive_keyword")
             - w("negative_keyword_weight") * c("negative_keyword")
             + w("position_weight") * c("spatial_relation"))
    total = total - (F.when(c("is_partial"), w("partial_date_penalty")).otherwise(F.lit(0.0))
                     + F.when(c("is_time_like"), w("time_like_penalty")).otherwise(F.lit(0.0)))
    bonus = (F.when(c("is_latest"), w("future_date_bonus") * c("source_prior"))
             .when(c("is_earliest_bare"), w("future_date_bonus") * -0.5 * c("source_prior"))
             .otherwise(F.lit(0.0)))
    return total + bonus + c("dmy_adjustment")


def evidence_tags() -> Column:
    tags = F.array(
        F.when(F.col("joined"), F.lit("joined_text")),
        F.when(F.col("is_latest"), F.lit("later_expiry_date")),
        F.when(F.col("calendar_valid"), F.lit("calendar_valid")).otherwise(F.lit("calendar_invalid")),
        F.when(F.col("positive_keyword") > 0, F.lit("expiry_keyword")),
        F.when(F.col("negative_keyword") > 0, F.lit("manufacturing_keyword")),
        F.when(F.col("spatial_relation") > 0, F.lit("bbox_spatial_relation")))
    return F.filter(tags, lambda t: t.isNotNull())


def _score(params: ScoreParams) -> Column:
    return score_column(lambda name: F.lit(float(getattr(params, name))))


def score_candidates(feats: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    return feats.withColumns({"score": _score(params), "evidence": evidence_tags()})


def feature_table(scored: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """The eleven reported features per candidate."""
    return scored.select(
        "image_id", "cand_ordinal", "recognition_confidence", "detection_confidence", "pattern_reliability",
        F.col("calendar").alias("calendar_valid"), "positive_keyword", "negative_keyword", "spatial_relation",
        "source_prior",
        F.when(F.col("is_partial"), params.partial_date_penalty).otherwise(0.0).alias("partial_date_penalty"),
        F.when(F.col("is_time_like"), params.time_like_penalty).otherwise(0.0).alias("time_like_penalty"),
        F.when(F.col("has_many_dates"), params.future_date_bonus).otherwise(0.0).alias("future_date_bonus"))


# --- ranking and selection -----------------------------------------------------------------------

R7_ORDER = ("score", "cand_ordinal")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Rank of every candidate in its image: score descending, generation order on ties."""
    return rank_in_groups(scored, "image_id", "score", "cand_ordinal",
                          lambda: candidate_tile(F.col("cand_ordinal")))


def select_best(scored: DataFrame, images: DataFrame | None = None, _params=None) -> DataFrame:
    """Top candidate per image; with ``images``, one row per image (null columns when none)."""
    best = top_per_group(scored, ["image_id"], [F.desc("score"), F.asc("cand_ordinal")]).drop("rank")
    return best if images is None else images.select("image_id").join(best, "image_id", "left")


def mark_leading(feats: DataFrame, params: ScoreParams = ScoreParams(), one_tile: bool = False) -> DataFrame:
    """Features with ``leads``: true for the best row of its image's tile (``one_tile`` where no image has several).

    Freshly built features are partitioned by their image (and tile), so this costs them no exchange, nor a sort with ``one_tile``.
    What selects from the stored table then sorts one row for each tile, not all candidates that a file's split holds.
    """
    w = Window.partitionBy("image_id") if one_tile else Window.partitionBy("image_id", candidate_tile(F.col("cand_ordinal")))
    return (feats.withColumn("__place", F.struct(_score(params).alias("score"), (-F.col("cand_ordinal")).alias("o")))
            .withColumn("leads", F.col("__place").eqNullSafe(F.max("__place").over(w))).drop("__place"))


def best_candidates(marked: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """``select_best`` over the rows that ``mark_leading`` marked under the same parameters, with score and evidence.

    ``marked`` should be a stored table. Where each image is one tile, its marked row is the choice, and nothing is sorted or shuffled.
    """
    leading = score_candidates(marked.filter("leads").drop("leads"), params)
    return leading if in_one_tile(marked, candidate_tile(F.col("cand_ordinal"))) else select_best(leading)


def other_source_iou(cands: DataFrame, stored: DataFrame | None = None, one_tile: bool | None = None) -> DataFrame:
    """Add ``source`` and ``spatial``: best IoU with a candidate box of the other source.

    ``stored`` is a stored table of the same candidates, from which boxes are read, so that features and scores are not worked out
    for them. Then, where each image is one tile with no more boxes of a source than one cell holds, candidates meet one row of
    their image, and they are neither shuffled again nor aggregated. ``one_tile`` is given where that is known already.
    """
    c = cands.withColumns({"source": candidate_source(F.col("sources")),
                           "tile": candidate_tile(F.col("cand_ordinal"))})
    if stored is not None and (in_one_tile(stored, candidate_tile(F.col("cand_ordinal"))) if one_tile is None else one_tile):
        of = lambda name: F.collect_set(F.when(candidate_source(F.col("sources")) == name, F.col("union_box")))
        sides = materialise(stored.select("image_id", "sources", "union_box").filter("union_box IS NOT NULL")
                            .groupBy("image_id").agg(of("yolo").alias("__yolo"), of("baseline").alias("__baseline")))
        if sides.filter(F.greatest(F.size("__yolo"), F.size("__baseline")) > BOXES_PER_CELL).isEmpty():
            other = F.when(F.col("source") == "yolo", F.col("__baseline")).otherwise(F.col("__yolo"))
            iou = lambda b: box_iou(F.col("union_box"), b)
            # few boxes need no array functions, which Spark does not compile; a place beyond the array is no box
            best = F.when(F.size("__other") <= FEW_BOXES, F.greatest(*[iou(F.get("__other", F.lit(i))) for i in range(FEW_BOXES)])).otherwise(
                F.array_max(F.transform("__other", iou)))
            return (c.join(sides, "image_id", "left").withColumn("__other", other).withColumn("spatial", F.coalesce(best, F.lit(0.0)))
                    .drop("tile", "__yolo", "__baseline", "__other"))
    boxes = c.select("image_id", F.when(F.col("source") == "yolo", "baseline").otherwise("yolo").alias("source"), "union_box",
                     F.col("tile").alias("block"))
    joined = meet_boxes(c, boxes, ["image_id", "source"], "tile", F.col("block"), ("union_box",), "union_box", "union_box", "left")
    best = F.array_max(F.transform("boxes", lambda b: box_iou(F.col("union_box"), b.union_box)))
    return per_candidate(joined.withColumn("__iou", best), c.columns, {"spatial": F.coalesce(F.max("__iou"), F.lit(0.0))},
                         keys=("image_id", "tile", "source", "cand_ordinal")).drop("tile")


def union_rank_column(params: UnionParams) -> Column:
    log = lambda name: F.log(F.greatest(F.col(name), F.lit(1e-6)))
    return (F.when(F.col("source") == "yolo", params.yolo_bonus).otherwise(0.0)
            + params.candidate_score_weight * F.col("score")
            + params.recognition_log_weight * log("recognition_confidence")
            + params.detection_log_weight * log("detection_confidence")
            + params.bbox_iou_weight * F.col("spatial"))


def select_union(scored: DataFrame, images: DataFrame | None = None,
                 params: UnionParams = UnionParams(), stored: DataFrame | None = None) -> DataFrame:
    """Top candidate over both token sources; ties fall back to score, then generation order.

    ``stored``: see ``other_source_iou``.
    """
    ranked = other_source_iou(scored, stored).withColumn("union_rank", union_rank_column(params))
    best = top_per_group(ranked, ["image_id"], [F.desc("union_rank"), F.desc("score"),
                                                F.asc("cand_ordinal")]).drop("rank")
    return best if images is None else images.select("image_id").join(best, "image_id", "left")


def diagnose_union_rank(pool: DataFrame) -> DataFrame:
    """Fixed-weight choice over a candidate pool (image_id, pool_ordinal, source, score, det)."""
    rank = (F.when(F.col("source") == "baseline", 1.0).otherwise(2.0) + F.col("score")
            + 0.4 * F.log(F.greatest(F.col("det"), F.lit(1e-6))))
    return top_per_group(pool.withColumn("union_rank", rank), ["image_id"],
                         [F.desc("union_rank"), F.asc("pool_ordinal")]).drop("rank")


def detector_choice(detector: DataFrame) -> DataFrame:
    """Per image the detector row of class 1 with the best rec*det, else the best of the others."""
    return top_per_group(detector, ["image_id"], [
        F.desc(F.col("class") == 1), F.desc(F.col("rec_score") * F.col("det_conf")),
        F.asc("candidate_index")]).drop("rank")


def best_box_per_image(boxes: DataFrame) -> DataFrame:
    """Class 1 (due) before class 0, then the largest area; other classes do not count."""
    return top_per_group(boxes.filter(F.col("class").isin(0, 1)), ["image_id"], [
        F.desc(F.col("class") == 1), F.desc(F.col("width") * F.col("height")), F.asc("box_index")]).drop("rank")


def top_k_boxes(boxes: DataFrame, k: int = 4, by: str = "aspect") -> DataFrame:
    """Keep k boxes per image by aspect ratio or by confidence, in original order on ties."""
    if by not in ("aspect", "confidence"):
        raise ValueError(f"Unknown priority: {by}")
    key = aspect_ratio(F.col("bbox")) if by == "aspect" else F.col("confidence")
    return top_per_group(boxes, ["image_id"], [F.desc(key), F.asc("box_index")], k)


def baseline_pool(scored: DataFrame) -> DataFrame:
    """Scored candidates as pool rows for the weight fits and diagnoses."""
    final = candidate_final_date(F.col("year"), F.col("month"), F.col("day"), F.col("calendar_valid"))
    return scored.select(
        "image_id", F.lit(0).alias("origin"), "score", "cand_ordinal", final.alias("prediction"),
        F.lit("baseline").alias("source"), F.col("recognition_confidence").alias("rec"),
        F.col("detection_confidence").alias("det"), F.lit(-1).alias("class"),
        F.col("union_box").alias("bbox")).filter(F.col("prediction").isNotNull())


SELECTORS = {"keyword_regex": (select_best, ScoreParams), "union_spatial": (select_union, UnionParams)}


def selector(name: str):
    if name not in SELECTORS:
        raise ValueError(f"Unknown selector '{name}'. Available: {sorted(SELECTORS)}")
    return SELECTORS[name]
