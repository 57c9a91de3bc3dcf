"""Shards by jump consistent hashing, with DataFrame functions only.

The generator behind the jumps is the published one: a 64-bit linear congruential step
``key * 2862933555777941757 + 1`` whose upper 31 bits give the next jump. Signed longs would
overflow under ANSI arithmetic, so the product is put together from 16-bit parts of the constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.llm.common import materialise, with_part_index

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_C = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
_LOW16, _LOW32 = (1 << 16) - 1, (1 << 32) - 1


def _low(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit halves of key * MULTIPLIER + 1 modulo 2^64."""
    p0, p1 = low * _C[0], low * _C[1]
    bottom = _low(p0, 32) + F.shiftleft(_low(p1, 16), 16) + 1
    top = (F.shiftright(p0, 32) + F.shiftright(p1, 16) + low * _C[2] + F.shiftleft(_low(low * _C[3], 16), 16)
           + high * _C[0] + F.shiftleft(_low(high * _C[1], 16), 16) + F.shiftright(bottom, 32))
    return _low(top, 32), _low(bottom, 32)


def jump_shard(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of a long key among ``shards`` shards, and among ``shards + 1``.

    The jumps of a key do not depend on the number of shards; only where they stop does. One walk
    therefore answers both. A walk makes about ln(shards) jumps, each to a larger shard.
    A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(_low(F.shiftrightunsigned(key, 32), 32).alias("high"), _low(key, 32).alias("low"),
                     zero.alias("at"), zero.alias("jump"))

    def walk(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        # at the end of the walk, larger jumps only have to stay past it
        jump = F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)))
        moved = F.struct(high.alias("high"), low.alias("low"), s["jump"].alias("at"),
                         F.least(jump, F.lit(shards + 1).cast("long")).alias("jump"))
        return F.when(s["jump"] < shards, moved).otherwise(s)

    # every jump moves on by one shard at least, so this many steps are enough for any key
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, walk)
    return (end["at"].cast("int"),
            F.when(end["jump"] == shards, F.lit(shards)).otherwise(end["at"]).cast("int"))


def shard(df: DataFrame, key: str, shards: int, shard_col: str = "shard", slot_col: str = "slot",
          grown_col: str = "grown_shard") -> DataFrame:
    """All rows and columns of ``df`` with the shard of their key, a gap-free slot in the shard
    (from 0), and the shard they would have with one more shard.

    A key is an integer, or any other type by its xxhash64. A null key goes to the shard of 0.
    Equal keys share a shard. Slots follow the input's order, task by task, and number rows, not
    keys: repeated rows and hot keys get slots of their own. An empty table stays empty. Columns
    named like one of the three new ones are replaced; ``__part`` and ``__row`` are reserved.

    Rows are stored with their input task and place in it. The slots of one (shard, task) group are
    numbered by a window over that group alone, so a hot shard is spread over as many groups as
    there were input tasks. Only group sizes meet in one place.
    """
    integer = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    at, grown = jump_shard(F.col(key) if integer else F.xxhash64(F.col(key)), shards)
    placed = materialise(with_part_index(df.withColumns({shard_col: at, grown_col: grown}), "__part", "__row"))
    group = Window.partitionBy(shard_col, "__part")
    before = Window.partitionBy(shard_col).orderBy("__part")
    offsets = (placed.groupBy(shard_col, "__part").agg(F.count("*").alias("__n"))
               .select(shard_col, "__part", (F.sum("__n").over(before) - F.col("__n")).alias("__offset")))
    return (placed.withColumn(slot_col, F.row_number().over(group.orderBy("__row")) - 1)
            .join(offsets, [shard_col, "__part"])
            .withColumn(slot_col, F.col(slot_col) + F.col("__offset"))
            .drop("__part", "__row", "__offset"))
