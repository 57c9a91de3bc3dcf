"""Which recognition pass an image uses: fast exit, tiers, retries and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from expirylens.functions.text import contains_any, is_dateish
from expirylens.operators.boxes import low_confidence_images
from expirylens.operators.candidates import images_without_candidates
from expirylens.operators.filters import filter_source
from expirylens.operators.ordering import renumber, top_per_group

# Case-sensitive keyword sets and limits of the fast exit.
EXPIRY_WORDS = ("소비", "유통", "까지", "기한", "EXP", "BBD", "BE")
NEGATIVE_WORDS = ("제조", "PROD", "MFG", "PKG")
MIN_YEAR, MAX_YEAR, FAST_EXIT_CONFIDENCE = 2020, 2035, 0.85


def can_fast_exit(tokens: DataFrame, cands: DataFrame, min_confidence: float = FAST_EXIT_CONFIDENCE,
                  min_year: int = MIN_YEAR, max_year: int = MAX_YEAR) -> DataFrame:
    """Ids whose most confident candidate is a plausible full date next to expiry words only."""
    best = top_per_group(cands, ["image_id"], [F.desc("recognition_confidence"), F.asc("cand_ordinal")])
    sure = best.filter(F.col("calendar_valid") & F.col("year").isNotNull() & F.col("day").isNotNull()
                       & F.col("year").cast("int").between(min_year, max_year)
                       & (F.col("recognition_confidence") >= min_confidence)).select("image_id")
    words = tokens.groupBy("image_id").agg(F.max(contains_any(F.col("text"), EXPIRY_WORDS)).alias("pos"),
                                           F.max(contains_any(F.col("text"), NEGATIVE_WORDS)).alias("neg"))
    return sure.join(words.filter("pos AND NOT neg").select("image_id"), "image_id", "left_semi")


def has_valid_candidate(cands: DataFrame, images: DataFrame, min_year: int = MIN_YEAR, max_year: int = MAX_YEAR) -> DataFrame:
    """image_id, has_valid: any valid candidate with a plausible year, or with month and day only."""
    ok = F.col("calendar_valid") & F.when(F.col("year").isNull(), F.col("day").isNotNull()).otherwise(
        F.col("year").cast("int").between(min_year, max_year))
    hit = cands.groupBy("image_id").agg(F.max(F.coalesce(ok, F.lit(False))).alias("has_valid"))
    return images.select("image_id").join(hit, "image_id", "left").withColumn("has_valid", F.coalesce("has_valid", F.lit(False)))


def tag_source(tokens: DataFrame, source: str) -> DataFrame:
    return tokens.withColumn("source", F.lit(source))


def merge_passes(*passes: DataFrame) -> DataFrame:
    """All passes' tokens, each image's positions renumbered in order of (pass, position)."""
    merged = None
    for number, tokens in enumerate(passes):
        part = tokens.withColumn("__pass", F.lit(number))
        merged = part if merged is None else merged.unionByName(part)
    return renumber(merged, "__pass").drop("__pass")


def route_tiers(tier1: DataFrame, tier2: DataFrame, tier3: DataFrame, fast: DataFrame) -> DataFrame:
    """Tokens per image after routing: fast-exit images keep tier 1, others get all tiers in order."""
    rest = lambda t: t.join(fast.select("image_id"), "image_id", "left_anti")
    return merge_passes(tier1, rest(tier2), rest(tier3))


def tier_reached(images: DataFrame, tier3: DataFrame, fast: DataFrame) -> DataFrame:
    f = fast.select("image_id").distinct().withColumn("fast", F.lit(True))
    t3 = tier3.select("image_id").distinct().withColumn("has3", F.lit(True))
    return images.select("image_id").join(f, "image_id", "left").join(t3, "image_id", "left").select(
        "image_id", F.when(F.col("fast"), 1).when(F.col("has3"), 3).otherwise(2).alias("tier_reached"))


def _pass_flags(tokens: DataFrame, name: str) -> DataFrame:
    return tokens.groupBy("image_id").agg(F.max(is_dateish(F.col("text"))).alias(f"{name}_dateish"))


def choose_pass(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Tokens of the first pass if any looks like a date, else of the retry if any does, else of the
    first pass, or of the retry where the first pass is empty. Adds column ``pass``."""
    flags = _pass_flags(first, "first").join(_pass_flags(retry, "retry"), "image_id", "full")
    keep_first = F.coalesce("first_dateish", F.lit(False)) | (
        ~F.coalesce("retry_dateish", F.lit(False)) & F.col("first_dateish").isNotNull())
    chosen = flags.select("image_id", F.when(keep_first, "first").otherwise("retry").alias("pass"))
    take = lambda t, p: t.join(chosen.filter(F.col("pass") == p), "image_id")
    return take(first, "first").unionByName(take(retry, "retry"))


def fill_missing_from_second_pass(base: DataFrame, second: DataFrame, extract, source: str) -> DataFrame:
    """Append second-pass tokens only where the first pass (without ``source``) has no candidate."""
    first = filter_source(base, source)
    bare = images_without_candidates(first, extract(first))
    # images whose tokens all came from the dropped source are empty now and count as bare
    emptied = base.select("image_id").distinct().join(first.select("image_id").distinct(), "image_id", "left_anti")
    ids = bare.unionByName(emptied)
    return merge_passes(first, second.join(ids, "image_id", "left_semi"))


def replace_low_confidence(first: DataFrame, fallback: DataFrame, images: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Low-confidence images take the fallback tokens when there are any, else keep their own."""
    low = low_confidence_images(first, images, threshold).select("image_id")
    swap = low.join(fallback.select("image_id").distinct(), "image_id", "left_semi")
    return first.join(swap, "image_id", "left_anti").unionByName(fallback.join(swap, "image_id", "left_semi"))
