"""Row numbers and ranks that never gather a whole table or a hot group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.plans.storage import materialise
from expirylens.schemas import tile_of


def with_global_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """Add a gap-free 0-based position in the total order of the table.

    The table is range partitioned, sorted inside partitions and stored; then only the partition
    sizes (one row per partition) are summed up in order. ``order`` must be unique per row.
    """
    local = F.monotonically_increasing_id()
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("*", F.shiftright(local, 33).cast("int").alias("__part"),
                      local.bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos")))
    placed = materialise(placed)
    by_part = Window.orderBy("__part")            # as many rows as there are partitions
    offsets = (placed.groupBy("__part").agg(F.count("*").alias("__n"))
               .select("__part", (F.sum("__n").over(by_part) - F.col("__n")).alias("__offset")))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__offset") + F.col("__pos"))
            .drop("__part", "__pos", "__offset"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1,
                  rank: str = "rank") -> DataFrame:
    """The first k rows of every group with their rank.

    A rank filter on row_number lets Spark cut every group to k rows on the map side
    (WindowGroupLimit), so even a huge group sends only k rows per task to the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def renumber(tokens: DataFrame, *passes: str) -> DataFrame:
    """Gap-free token positions per image, from 0, in order of (passes, token_index).

    Tokens are numbered inside their (image, pass, tile) and shifted by the sizes of those before, so an
    image with a large share of all tokens is spread over its tiles. Equal positions follow by text.
    """
    keys = ["image_id", *passes, "__tile"]
    t = tokens.withColumn("__tile", tile_of(F.col("token_index")))
    before = Window.partitionBy("image_id").orderBy(*keys[1:])      # one row per pass and tile
    shift = (t.groupBy(*keys).agg(F.count("*").alias("__n"))
             .select(*keys, (F.sum("__n").over(before) - F.col("__n")).alias("__shift")))
    inside = Window.partitionBy(*keys).orderBy("token_index", "text")
    return (t.withColumn("__pos", F.row_number().over(inside) - 1).join(shift, keys)
            .withColumn("token_index", (F.col("__shift") + F.col("__pos")).cast("int"))
            .select(*tokens.columns))


def in_one_tile(df: DataFrame, tile: str | Column) -> bool:
    """True where every row is of the first tile, as in tables without huge groups. Reads the table, so it should be a stored one."""
    return df.filter((F.col(tile) if isinstance(tile, str) else tile) != 0).isEmpty()


def join_by_tile(left: DataFrame, right: DataFrame, key: str | list[str], tile: str, how: str = "inner", single: bool = False) -> DataFrame:
    """Join rows that carry a tile number with per-key rows, spread over the key's tiles.

    The few per-key rows are copied to every tile that the left side has, so a key with very many rows
    is joined tile by tile, and a later aggregation by (key, tile) needs no further exchange. With ``single`` (see
    ``in_one_tile``) there is nothing to copy, and the rows are joined by their key.
    """
    keys = [key] if isinstance(key, str) else key
    if single:
        return left.join(right, keys, how)
    spread = right.join(left.select(*keys, tile).distinct(), keys)
    return left.join(spread, [*keys, tile], how)


# Pieces a huge group is cut into for ranking.
RANK_BUCKETS = 1024


def rank_in_groups(df: DataFrame, key: str, score: str, ordinal: str, tile: Callable[[], Column],
                   rank: str = "rank", max_tile: int = 0) -> DataFrame:
    """Full rank by (score desc, ordinal asc) inside each group, for groups of any size.

    Groups that span more than one tile are cut at score quantiles. A score so frequent that it
    is a quantile twice gets its own bucket, which the ordinal's tile splits further. Each bucket
    is numbered by itself and shifted by the sizes of the buckets before it. Small groups are one
    bucket, so this is a plain window for them.
    """
    t = df.withColumn("__tile", tile())
    large = (t.groupBy(key).agg(F.max("__tile").alias("__tiles"))
             .filter(F.col("__tiles") > max_tile).select(key))
    steps = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    cuts = (t.select(key, score).join(large, key, "left_semi").groupBy(key)
            .agg(F.percentile_approx(score, F.lit(steps), 10 * RANK_BUCKETS).alias("__cuts")))
    b = t.join(cuts, key, "left")
    s = F.col(score)
    heavy = F.size(F.filter("__cuts", lambda c: c == s)) > 1
    b = b.withColumns({
        # larger scores first: count the cuts above; an own bucket comes after those above it
        "__bucket": F.coalesce(F.size(F.filter("__cuts", lambda c: c > s)) * 2
                               + F.when(heavy, 0).otherwise(F.when(
                                   F.array_contains("__cuts", s), 0).otherwise(-1)), F.lit(0)),
        "__sub": F.when(heavy, F.col("__tile")).otherwise(0)}).drop("__cuts", "__tile")
    bucket = ["__bucket", "__sub"]
    inside = Window.partitionBy(key, *bucket).orderBy(F.desc(score), F.asc(ordinal))
    before = Window.partitionBy(key).orderBy(*bucket)
    shift = (b.groupBy(key, *bucket).agg(F.count("*").alias("__n"))
             .select(key, *bucket, (F.sum("__n").over(before) - F.col("__n")).alias("__shift")))
    return (b.withColumn("__pos", F.row_number().over(inside))
            .join(shift, [key, *bucket])
            .withColumn(rank, (F.col("__shift") + F.col("__pos")).cast("int"))
            .drop("__shift", "__pos", *bucket))
