"""Joins of boxes that may overlap, inside each image, over a hierarchy of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from expirylens.operators.ordering import in_one_tile, join_by_tile
from expirylens.plans.storage import materialise

# Boxes that a cell of the finest grid holds on average; an image with no more is one cell.
BOXES_PER_CELL = 64
# Halvings of a side at most: the finest grid has 4 ** 12 cells.
MOST_LEVELS = 12


def dense_groups(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """The groups that hold more boxes than one cell does, with their number ``n``."""
    return arrays.groupBy(*keys).agg(F.sum(F.size("boxes")).alias("n")).filter(F.col("n") > BOXES_PER_CELL)


def dense_grids(arrays: DataFrame, dense: DataFrame, keys: list[str], box: str) -> DataFrame:
    """Extent and number of halvings (``__grid``) of the dense groups.

    The table is stored, so Spark knows its size and broadcasts it only below its own threshold.
    """
    finite = lambda v: F.when(F.abs(v) < 1e300, v)
    side = lambda names: F.flatten(F.transform("boxes", lambda b: F.array(*[finite(b[box][n]) for n in names])))
    extent = (arrays.join(dense, keys).groupBy(*keys).agg(F.first("n").alias("n"), *[
        f(g(side(names))).alias(name) for name, names, f, g in (("x", ("x1", "x2"), F.min, F.array_min), ("y", ("y1", "y2"), F.min, F.array_min),
                                                               ("x_end", ("x1", "x2"), F.max, F.array_max), ("y_end", ("y1", "y2"), F.max, F.array_max))]))
    levels = F.least(F.lit(MOST_LEVELS), F.ceil(F.log2(F.sqrt(F.col("n") / BOXES_PER_CELL)))).cast("int")
    length = lambda a, z: F.when(F.col(z) > F.col(a), F.col(z) - F.col(a)).otherwise(1.0)
    return materialise(extent.select(*keys, F.struct(
        F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), length("x", "x_end").alias("width"),
        length("y", "y_end").alias("height"), levels.alias("levels")).alias("__grid")))


def _cells(box: Column, grid: Column, asks: bool) -> Column:
    """The cells of a box as array<struct<own, level, x, y>>.

    The own level of a box is the finest one at which it covers at most four cells. Two boxes meet at the coarser one of their
    own levels. So asking rows visit the boxes at home in their cells of the own and all coarser levels (``own``), and where
    they are at home themselves, the boxes of finer levels that pass there (not ``own``).
    """
    last = F.call_function("shiftleft", F.lit(1), grid.levels) - 1
    place = lambda v, start, size: F.floor(F.least(last.cast("double"), F.greatest(
        F.lit(0.0), (v - start) / size * (last + 1)))).cast("int")
    span = F.struct(place(F.least(box.x1, box.x2), grid.x, grid.width).alias("x1"), place(F.greatest(box.x1, box.x2), grid.x, grid.width).alias("x2"),
                    place(F.least(box.y1, box.y2), grid.y, grid.height).alias("y1"), place(F.greatest(box.y1, box.y2), grid.y, grid.height).alias("y2"))
    up = lambda v, level: F.call_function("shiftright", v, level)

    def at(s: Column, level: Column, own: bool) -> Column:
        xs = F.array_distinct(F.array(up(s.x1, level), up(s.x2, level)))
        ys = F.array_distinct(F.array(up(s.y1, level), up(s.y2, level)))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: _cell(F.lit(own), level, x, y))))

    def all_cells(s: Column) -> Column:
        fits = lambda k: (up(s.x2, k) - up(s.x1, k) <= 1) & (up(s.y2, k) - up(s.y1, k) <= 1)
        # the coarsest grid is one cell, so there always is one
        own = F.array_min(F.filter(F.sequence(F.lit(0), grid.levels), fits))
        coarser = lambda flag, start: F.flatten(F.transform(F.filter(
            F.sequence(F.lit(0), grid.levels), lambda k: k >= start), lambda k: at(s, k, flag)))
        if asks:
            return F.concat(coarser(True, own), F.when(own > 0, at(s, own, False)).otherwise(F.array().cast(CELLS)))
        return F.concat(at(s, own, True), coarser(False, own + 1))

    one = F.array(_cell(F.lit(True), F.lit(0), F.lit(0), F.lit(0)))
    inside = F.element_at(F.transform(F.array(span), all_cells), 1)
    return F.when(grid.isNull() | box.isNull(), one).otherwise(inside)


CELLS = "array<struct<own:boolean,level:int,x:int,y:int>>"


def _cell(own: Column, level: Column, x: Column, y: Column) -> Column:
    return F.struct(own.alias("own"), level.alias("level"), x.alias("x"), y.alias("y"))


def meet_boxes(rows: DataFrame, boxes: DataFrame, keys: list[str], tile: str, block: Column, fields: tuple[str, ...],
               row_box: str = "bbox", box: str = "bbox", how: str = "inner") -> DataFrame:
    """Rows with the arrays (``boxes``, structs of the fields) of all boxes of their group that may overlap them.

    A row comes back once for each array, so what follows must be an aggregate that repeats don't change, such as the best
    overlap. Boxes that are not in an array of a row do not overlap it. With ``how="left"`` every row stays, else those of
    groups that have a box at all. The fields hold the box. A group with few boxes is one cell; in one with n rows and boxes work grows with n log n
    and with the pairs that do overlap. Boxes that lie on top of each other are cut into blocks, rows into tiles.
    """
    arrays = materialise(boxes.filter(F.col(box).isNotNull()).groupBy(*keys, block.alias("__block"))
                         .agg(F.collect_set(F.struct(*fields)).alias("boxes")))
    many = dense_groups(arrays, keys)
    if many.isEmpty():                            # every group is one cell
        return join_by_tile(rows, arrays.drop("__block"), keys, tile, how, in_one_tile(rows, tile))
    grids = dense_grids(arrays, many, keys, box)
    placed = rows.join(grids, keys, "left").withColumn("__cell", F.explode(_cells(F.col(row_box), F.col("__grid"), True)))
    one = F.transform("boxes", lambda b: F.struct(b.alias("box"), _cells(b[box], F.col("__grid"), False).alias("cells")))
    dense = (arrays.join(grids, keys).select(*keys, "__block", F.explode(one).alias("b"))
             .select(*keys, "__block", "b.box", F.explode("b.cells").alias("__cell"))
             .groupBy(*keys, "__cell", "__block").agg(F.collect_list("box").alias("boxes")))
    small = arrays.join(grids, keys, "left_anti").withColumn("__cell", _cell(*map(F.lit, (True, 0, 0, 0))))
    met = join_by_tile(placed, dense.unionByName(small).drop("__block"), [*keys, "__cell"], tile, "left")
    if how == "inner":
        met = met.filter(F.col("boxes").isNotNull() | F.col("__grid").isNotNull())
    return met.drop("__cell", "__grid")
