"""Filters, samples and splits over id and label tables.

Positions in a global order come from ``with_global_index``, so none of these sorts a whole table
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.functions.text import file_stem, looks_date_like, trim_ws
from expirylens.operators.ordering import renumber, with_global_index


def filter_ids(df: DataFrame, ids: DataFrame, id_col: str = "image_id") -> DataFrame:
    return df.join(ids.select(file_stem(F.col("id")).alias(id_col)).distinct(), id_col, "left_semi")


def last_per_id(df: DataFrame, id_col: str = "image_id", order: str = "row_order") -> DataFrame:
    """One row per id: the last by ``order`` where the table has that column, else the greatest by its other columns.

    Label joins take labels through this, so a repeated id never multiplies rows. It combines on the map side, and the
    join that follows reuses its partitioning.
    """
    rest = [c for c in df.columns if c != id_col]
    by = F.struct(*([order] if order in rest else []), *[c for c in rest if c != order])
    return df.groupBy(id_col).agg(F.max(by).alias("__r")).select(*[id_col if c == id_col else F.col(f"__r.{c}").alias(c) for c in df.columns])


def limit_images(df: DataFrame, n: int, order: str = "image_id") -> DataFrame:
    """First n rows by path; Spark takes the top n per partition before merging them."""
    return df.orderBy(order).limit(n)


def shard(df: DataFrame, index: int, count: int, order: str = "image_id") -> DataFrame:
    """Every count-th row of the ordered table, starting at index."""
    if not 0 <= index < count:
        raise ValueError(f"index {index} is not one of {count} shards")
    return with_global_index(df, order).filter(F.pmod("row_index", F.lit(count)) == index).drop("row_index")


def date_like_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.filter(looks_date_like(F.col("text")))


def label_group(final_date: Column) -> Column:
    parts = F.split(final_date, "-")
    return (F.when(F.upper(final_date) == "NONE", "none")
            .when(F.lower(F.get(parts, F.lit(0))) == "none", "year_missing")
            .when(F.lower(F.get(parts, F.lit(2))) == "none", "day_missing").otherwise("full"))


def evenly_spaced_sample(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """n rows at (half-even) rounded even distances over the ordered table; all rows when n >= size."""
    indexed = with_global_index(df, *order)
    total = indexed.count()
    if n is None or n >= total:
        return indexed.drop("row_index")
    if n < 2:
        return indexed.filter("row_index = 0").drop("row_index")
    # the wanted positions are computed from the row's own position: which i could round to it
    step = F.lit(float(total - 1)) / F.lit(float(n - 1))
    guess = F.floor(F.col("row_index") / step).cast("double")
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = guess + shift
        at = F.rint(i * F.lit(float(total - 1)) / F.lit(float(n - 1)))
        hit = hit | ((i >= 0) & (i <= n - 1) & (at == F.col("row_index")))
    return indexed.filter(hit).drop("row_index")


def hash_split(df: DataFrame, dev_count: int, id_col: str = "image_id") -> DataFrame:
    """Add ``split``: the dev_count smallest sha-256 hashes of the id are dev, the rest lock."""
    total = df.count()
    if not 0 < dev_count < total:
        raise ValueError("dev_count must be between 1 and the number of labeled images minus one")
    hashed = df.withColumn("__h", F.sha2(F.col(id_col).cast("string"), 256))
    return (with_global_index(hashed, "__h", id_col)
            .withColumn("split", F.when(F.col("row_index") < dev_count, "dev").otherwise("lock"))
            .drop("__h", "row_index"))


def holdout_allocation(strata: DataFrame, holdout: int) -> DataFrame:
    """Rows per stratum (columns of ``strata`` plus n): proportional shares, then single steps.

    Missing rows go one by one to the stratum with the most unallocated rows; surplus rows are
    taken one by one from the largest allocation. Both series of single steps are the top of an
    ordered list of (stratum, step) pairs, so they are a rank and a count here, not a loop.
    """
    keys = [c for c in strata.columns if c != "n"]
    total = strata.agg(F.sum("n").alias("total"))
    a = (strata.crossJoin(F.broadcast(total))
         .withColumn("share", F.rint(F.col("n") * F.lit(float(holdout)) / F.col("total")).cast("long")))
    short = F.lit(holdout) - F.sum("share").over(Window.partitionBy())
    a = a.withColumn("short", short)
    # adding: after s steps a stratum has n - share - s rows left; removing: share - s
    level = F.when(F.col("short") > 0, F.col("n") - F.col("share")).otherwise(F.col("share"))
    steps = F.sequence(F.lit(0), F.least(F.abs("short"), level) - 1)
    pairs = (a.withColumn("level", level).filter((F.col("short") != 0) & (F.col("level") > 0))
             .withColumn("s", F.explode(steps)))
    taken = (pairs.withColumn("pick", F.row_number().over(
                Window.partitionBy().orderBy(F.desc(F.col("level") - F.col("s")), *keys)))
             .filter(F.col("pick") <= F.abs("short")).groupBy(*keys).agg(F.count("*").alias("moved")))
    sign = F.when(F.col("short") > 0, 1).otherwise(-1)
    return (a.join(taken, keys, "left")
            .select(*keys, "n", (F.col("share") + sign * F.coalesce("moved", F.lit(0))).alias("holdout_n")))


def stratified_holdout(labels: DataFrame, holdout: int, seed: int) -> DataFrame:
    """Add ``split`` (holdout/train) with a proportional holdout per (label group, confidence).

    Inside a stratum the rows with the smallest seeded hash are held out. The rows of a stratum
    are numbered through the global order (stratum, hash), so a stratum with most of the rows is
    not gathered in one task.
    """
    rows = labels.withColumns({
        "label_group": label_group(F.col("final_date")),
        "confidence": F.coalesce(F.col("confidence").cast("string"), F.lit("unknown")) if "confidence" in
        labels.columns else F.lit("unknown"),
        "__h": F.xxhash64(F.lit(seed), "image_id")})
    indexed = with_global_index(rows, "label_group", "confidence", "__h", "image_id")
    strata = indexed.groupBy("label_group", "confidence").agg(
        F.count("*").alias("n"), F.min("row_index").alias("first"))
    plan = holdout_allocation(strata.drop("first"), holdout).join(
        strata.drop("n"), ["label_group", "confidence"]).drop("n")
    return (indexed.join(plan, ["label_group", "confidence"])
            .withColumn("split", F.when(F.col("row_index") - F.col("first") < F.col("holdout_n"), "holdout")
                        .otherwise("train"))
            .drop("row_index", "first", "holdout_n", "__h"))


def head_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.orderBy(*order).limit(n)


def review_filter(review: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Rows of the review table by outcome and by a lower-case substring over four columns."""
    conditions = {"all": F.lit(True), "fail": F.col("is_correct") == F.lit(False),
                  "pass": F.col("is_correct") == F.lit(True), "none": F.col("final_date") == "NONE"}
    if mode not in conditions:
        raise ValueError(f"Unknown mode: {mode}")
    out = review.filter(conditions[mode])
    if query:
        text = F.lower(F.concat_ws(" ", "image_id", F.coalesce("ground_truth", F.lit("")), "final_date",
                                   F.coalesce("ocr_text", F.lit(""))))
        out = out.filter(text.contains(query.lower()))
    return out


def filter_source(tokens: DataFrame, source: str) -> DataFrame:
    """Tokens of all other sources; their positions close up."""
    return renumber(tokens.filter(~F.col("source").eqNullSafe(source)))


def pending_items(items: DataFrame, done: DataFrame, batch_size: int, key: str = "image_id") -> DataFrame:
    """Items without a successful label, numbered into batches of batch_size."""
    left = items.join(done.select(key).distinct(), key, "left_anti")
    return (with_global_index(left, key)
            .withColumn("batch", F.floor(F.col("row_index") / batch_size)).drop("row_index"))


def keep_trainable_labels(labels: DataFrame) -> DataFrame:
    f = F.col("final_date")
    return labels.filter((f != "") & (F.upper(f) != "NONE") & ~f.contains("None"))


def explode_label_lines(labels: DataFrame, text: str = "text_found", min_length: int = 3, order: str = "image_id") -> DataFrame:
    """Lines of multi-line texts: trimmed, long enough, each line once in the whole table.

    A line stays with its first row by ``order``, at its first place there; the lines a row keeps are numbered in order.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), trim_ws),
                     lambda s: F.length(s) >= min_length)
    rows = labels.select("image_id", F.col(order).alias("__row"), F.posexplode(F.array_distinct(lines)).alias("__at", "line"))
    first = rows.groupBy("line").agg(F.min(F.struct("__row", "image_id", "__at")).alias("f"))
    kept = first.select("f.image_id", F.col("f.__row").alias("__row"), F.col("f.__at").alias("__at"), "line")
    number = Window.partitionBy("image_id").orderBy("__row", "__at")      # the lines of one row
    return kept.select("image_id", (F.row_number().over(number) - 1).alias("line_number"), "line")


def charset(labels: DataFrame, label: str) -> DataFrame:
    """One row with all distinct characters of the labels, sorted by code point."""
    chars = labels.select(F.explode(F.split(label, "")).alias("ch")).filter("ch <> ''").distinct()
    return chars.agg(F.array_join(F.array_sort(F.collect_list("ch")), "").alias("charset"), F.count("*").alias("size"))


# Class maps of the box detector data sets.
CLASS_MODES = {
    "region4": {0: 0, 1: 1, 2: 2, 3: 3},
    "expiry_binary": {0: 0, 1: 0},
    "expiry_full": {0: 0, 1: 0, 3: 1},
    "date_due_full": {0: 0, 1: 1, 3: 2},
}
CLASS_NAMES = {"region4": ("date", "due", "code", "full"), "expiry_binary": ("expiry",),
               "expiry_full": ("expiry", "full"), "date_due_full": ("date", "due", "full")}


def remap_classes(boxes: DataFrame, mode: str) -> DataFrame:
    """Replace ``class`` through one of the class maps; boxes of other classes are dropped."""
    if mode not in CLASS_MODES:
        raise ValueError(f"Unknown class mode: {mode}; available: {sorted(CLASS_MODES)}")
    table = F.create_map(*[F.lit(v) for kv in CLASS_MODES[mode].items() for v in kv])
    return boxes.filter(F.col("class").isin(*CLASS_MODES[mode])).withColumn(
        "class", F.element_at(table, F.col("class").cast("int")))
