"""Rebuild physical text rows from token boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.functions.text import trim_ws
from expirylens.schemas import ORDINAL_STRIDE, as_tokens

# Images with more tokens than this are first cut at empty horizontal bands.
MAX_TOKENS_IN_ONE_FOLD = 2048

# Tokens whose row numbers are gathered together.
FOLD_CHUNK = 256

# Island numbers of the two special cases.
_BOXLESS_ISLAND = 1 << 30


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _row_numbers(sorted_tokens: Column, y_tolerance: float) -> Column:
    """Row number of every token of an array sorted by (centre y, left edge), as an array for each FOLD_CHUNK tokens.

    A token joins the first row whose running mean is close enough, otherwise it opens a new
    row. The mean moves with every token, so this is a fold. Tokens come by centre y: a row whose mean lies further
    above than the tolerance times the tallest box is out of reach for good and leaves the fold, which
    holds the rows within reach only. Numbers are gathered by chunk, so that no step copies all of them.
    """
    rows_type = "array<struct<id:int,total:double,n:int,h:double>>"
    reach = F.array_max(F.transform(sorted_tokens, lambda t: t.h)) * y_tolerance
    start = F.struct(F.array().cast(rows_type).alias("rows"), F.lit(0).alias("next"), reach.alias("reach"))

    def step(acc: Column, t: Column) -> Column:
        def place(live: Column, first: Column) -> Column:
            opened = F.concat(live, F.array(F.struct(acc.next.alias("id"), t.cy.alias("total"), F.lit(1).alias("n"), t.h.alias("h"))))
            grown = F.transform(live, lambda r: F.when(r.id == first, F.struct(
                r.id.alias("id"), (r.total + t.cy).alias("total"), (r.n + 1).alias("n"), F.greatest(r.h, t.h).alias("h"))).otherwise(r))
            return F.struct(F.when(first.isNull(), opened).otherwise(grown).alias("rows"),
                            (acc.next + first.isNull().cast("int")).alias("next"), acc.reach.alias("reach"),
                            F.concat(acc.assigned, F.array(F.coalesce(first, acc.next))).alias("assigned"))

        def first_fit(live: Column) -> Column:
            fits = F.filter(live, lambda r: F.abs(t.cy - r.total / r.n) <= F.lit(y_tolerance) * F.greatest(t.h, r.h))
            return F.array_min(F.transform(fits, lambda r: r.id))

        in_reach = F.filter(acc.rows, lambda r: t.cy - r.total / r.n <= acc.reach * (1 + 1e-9))
        return _bound(in_reach, lambda live: _bound(first_fit(live), lambda first: place(live, first)))

    def chunk(acc: Column, tokens: Column) -> Column:
        zero = F.struct(acc.rows.alias("rows"), acc.next.alias("next"), acc.reach.alias("reach"), F.array().cast("array<int>").alias("assigned"))
        return _bound(F.aggregate(tokens, zero, step), lambda end: F.struct(
            end.rows.alias("rows"), end.next.alias("next"), end.reach.alias("reach"), F.concat(acc.done, F.array(end.assigned)).alias("done")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sorted_tokens) - 1) / FOLD_CHUNK)), lambda i: F.slice(sorted_tokens, i * FOLD_CHUNK + 1, FOLD_CHUNK))
    zero = F.struct(start.rows.alias("rows"), start.next.alias("next"), start.reach.alias("reach"), F.array().cast("array<array<int>>").alias("done"))
    return F.aggregate(chunks, zero, chunk).done


def _islands(tokens: DataFrame, y_tolerance: float) -> DataFrame:
    """Attach an island number to each token; islands can be folded on their own.

    Ordinary images are one island. In a very large image, rows can only reach over a vertical
    distance of tolerance * tallest box, so an empty band of that height separates tokens that
    can never meet: the image is cut there and every island is folded by itself, with the same
    result as one long fold.
    """
    stats = tokens.groupBy("image_id").agg(F.count("*").alias("__n"), F.max("h").alias("__hmax"))
    large = stats.filter(F.col("__n") > MAX_TOKENS_IN_ONE_FOLD).select(
        "image_id", (F.col("__hmax") * y_tolerance * (1 + 1e-9)).alias("__band"))
    band = F.floor(F.col("cy") / F.col("__band"))
    marked = tokens.join(large, "image_id", "left").withColumn("__cell", band)
    cells = (tokens.join(large, "image_id").select("image_id", band.alias("__cell")).distinct())
    by_cell = Window.partitionBy("image_id").orderBy("__cell")
    starts = F.when(F.col("__cell") - F.lag("__cell").over(by_cell) > 1, 1).otherwise(0)
    numbered = (cells.withColumn("__start", starts)
                .withColumn("__island", F.sum("__start").over(by_cell).cast("int"))
                .drop("__start"))
    return (marked.join(numbered, ["image_id", "__cell"], "left")
            .withColumn("island", F.coalesce(F.col("__island"), F.lit(0)))
            .drop("__band", "__cell", "__island"))


def reconstruct_lines(tokens: DataFrame, y_tolerance: float = 0.6) -> DataFrame:
    """One row per text line: image_id, line_ordinal, text, members (token structs in line order).

    Box-less tokens form one last line in their original order. Lines without text are dropped.
    ``line_ordinal`` orders the lines of an image.
    """
    t = as_tokens(tokens).withColumn("token_text", trim_ws(F.col("text")))
    b = F.col("bbox")
    boxed = t.filter(b.isNotNull()).withColumns({
        "cy": (b.y1 + b.y2) / 2.0, "h": F.greatest(F.lit(1.0), b.y2 - b.y1), "left": b.x1})
    boxless = (t.filter(b.isNull())
               .withColumns({"cy": F.lit(0.0), "h": F.lit(1.0), "left": F.lit(0.0),
                             "island": F.lit(_BOXLESS_ISLAND)}))
    member = F.struct(F.col("cy"), F.col("left"), F.col("token_index"), F.col("h"),
                      F.col("token_text"), F.col("confidence"),
                      F.coalesce(F.col("detection_confidence"),
                                 F.try_element_at("extras", F.lit("detection_confidence")).try_cast("double"),
                                 F.lit(0.0)).alias("detection_confidence"),
                      F.col("bbox"), F.col("source"))
    folded = (_islands(boxed, y_tolerance).select("image_id", "island", member.alias("m"))
              .groupBy("image_id", "island").agg(F.array_sort(F.collect_list("m")).alias("members")))
    numbered = folded.select("image_id", "island", F.inline(F.arrays_zip(
        F.flatten(_row_numbers(F.col("members"), y_tolerance)).alias("row"), F.col("members").alias("m"))))
    # a row is a group of its own, so the rows of a dense page spread; inside it: left to right, equal left edges in the fold's order
    rows = (numbered.unionByName(boxless.select("image_id", "island", F.lit(0).alias("row"), member.alias("m")))
            .groupBy("image_id", "island", "row").agg(F.array_sort(F.collect_list(F.struct("m.left", "m.cy", "m"))).alias("line")))
    ordered = F.transform("line", lambda x: x.m)
    texts = F.filter(F.transform("members", lambda m: m.token_text), lambda s: s != "")
    return (rows.select("image_id",
                        (F.col("island").cast("long") * ORDINAL_STRIDE + F.col("row")).alias("line_ordinal"),
                        ordered.alias("members"))
            .withColumn("text", F.array_join(texts, " "))
            .withColumn("token_indices", F.transform("members", lambda m: m.token_index))
            .filter(F.col("text") != ""))
