"""Label audits, submission checks, id checks and split leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.functions.dates import calendar_valid
from expirylens.functions.text import trim_ws
from expirylens.operators.filters import last_per_id
from expirylens.operators.ordering import with_global_index
from expirylens.schemas import tile_of

# The label shape and the plausible years.
STRICT_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
YEAR_MISSING = r"(?i)^NoNE-\d{2}-\d{2}$"
MIN_YEAR, MAX_YEAR = 2018, 2035
FLAG_TYPES = ("MISSING_IMAGE_ID", "FINAL_NONE_BUT_COMPONENTS_SET", "INVALID_DATE_FORMAT", "COMPONENT_MISMATCH",
              "CALENDAR_INVALID", "YEAR_OUTLIER", "GT_MISMATCH", "OCR_HALLUCINATION_OR_MISSING")


def token_text(tokens: DataFrame, longest: int) -> DataFrame:
    """Token texts in order, one row per tile of an image: all_text, packed, and the cut before it.

    ``packed`` keeps word characters only. ``cut`` joins the end of the packed text before a tile
    with its start, so that sequences of up to ``longest`` characters across a cut are seen. Tiles bound every string.
    """
    edge = max(1, longest - 1)
    t = tokens.select("image_id", tile_of(F.col("token_index")).alias("tile"), "token_index", "text")
    text = (t.groupBy("image_id", "tile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                F.struct("token_index", "text"))), lambda x: x.text), " ").alias("all_text"))
            .withColumn("packed", F.regexp_replace("all_text", r"(?U)[^\w]", "")))
    edges = (text.filter("packed <> ''").select("image_id", "tile", F.substring("packed", 1, edge).alias("head"),
                                                F.right("packed", F.lit(edge)).alias("tail")))
    # every tile left here has at least one character, so this many tiles before it suffice
    before = Window.partitionBy("image_id").orderBy("tile").rowsBetween(-edge, -1)
    cuts = edges.select("image_id", F.lit("").alias("all_text"), F.concat(
        F.right(F.array_join(F.collect_list("tail").over(before), ""), F.lit(edge)), "head").alias("packed"), "tile")
    return text.select("image_id", "all_text", "packed").unionByName(
        cuts.filter("tile > 0").select("image_id", "all_text", "packed"))


def token_evidence(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Is a label's date written in the image's tokens: image_id, year, month, day, token_found.

    Found means its digits in one of four orders without separators, or all three parts anywhere.
    Images without tokens have no row.
    """
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    short = F.when(F.length(y) == 4, F.substring(y, 3, 2)).otherwise(y)
    packed = F.col("packed")
    sequence = F.lit(False)
    for order in ((y, m, d), (short, m, d), (d, m, y), (d, m, short)):
        sequence = sequence | packed.contains(F.concat(*order))
    has = lambda c: F.max(F.col("all_text").contains(c))
    longest = labels.agg(F.max(F.length(F.concat(y, m, d)))).first()[0] or 1
    return (labels.select("image_id", "year", "month", "day").distinct().join(token_text(tokens, longest), "image_id")
            .groupBy("image_id", "year", "month", "day")
            .agg((F.max(sequence) | (has(y) & has(m) & has(d))).alias("token_found")))


def audit_labels(labels: DataFrame, truth: DataFrame | None = None, tokens: DataFrame | None = None,
                 min_year: int = MIN_YEAR, max_year: int = MAX_YEAR, images: DataFrame | None = None) -> DataFrame:
    """Flags per label row (types and messages), ``is_clean`` and the facts the summary counts.

    ``images`` has the ids of all images whose tokens were read, those without any token too: a label of
    an image without tokens is not evidenced. Repeated truth ids count once, the last one.
    """
    c = F.col
    rows = labels.select(*[trim_ws(F.coalesce(F.col(n), F.lit(""))).alias(n)
                           for n in ("image_id", "year", "month", "day", "final_date")])
    if truth is not None:
        have = set(truth.columns)
        t = last_per_id(truth).select("image_id", *[(trim_ws(F.coalesce(F.col(n), F.lit(""))) if n in have else F.lit("")).alias(f"gt_{n}")
                                       for n in ("year", "month", "day", "final_date")], F.lit(True).alias("has_gt"))
        rows = rows.join(t, "image_id", "left")
    else:
        rows = rows.withColumns({**{f"gt_{n}": F.lit(None).cast("string") for n in ("year", "month", "day", "final_date")},
                                 "has_gt": F.lit(False)})
    if tokens is not None:
        found = token_evidence(tokens, rows.filter("final_date <> 'NONE'")).withColumnRenamed("token_found", "__found")
        rows = rows.join(found, ["image_id", "year", "month", "day"], "left")
        if images is not None:
            read = images.select("image_id").distinct().withColumn("__read", F.lit(True))
            empty = F.col("__read") & (F.col("final_date") != "NONE")
            rows = rows.join(read, "image_id", "left").withColumn("__found", F.coalesce("__found", F.when(empty, F.lit(False)))).drop("__read")
    else:
        rows = rows.withColumn("__found", F.lit(None).cast("boolean"))
    none = c("final_date") == "NONE"
    # a date of that shape has its parts at fixed places
    rows = rows.withColumn("__shaped", ~none & c("final_date").rlike(STRICT_DATE))
    fy, fm, fd = (F.substring("final_date", at, n) for at, n in ((1, 4), (6, 2), (9, 2)))
    rows = rows.withColumn("is_real", c("__shaped") & calendar_valid(fy, fm, fd))
    real = c("is_real")
    year_value = F.when(real, fy.try_cast("int"))
    has_gt = F.coalesce(c("has_gt"), F.lit(False))
    checked = c("__found").isNotNull() & ~none
    rows = rows.withColumns({
        "is_none": none, "year_value": year_value, "gt_checked": has_gt,
        "gt_equal": has_gt & (c("final_date") == c("gt_final_date")), "token_checked": checked,
        "token_found": checked & F.coalesce(c("__found"), F.lit(False))})
    diff = lambda letter, n: F.when(c(n) != c(f"gt_{n}"), F.concat(F.lit(letter + "("), c(n), F.lit("!=gt:"), c(f"gt_{n}"), F.lit(")")))
    reason = F.concat(F.lit("["), F.concat_ws(", ", diff("Y", "year"), diff("M", "month"), diff("D", "day")), F.lit("]"))

    flags = (
        ("MISSING_IMAGE_ID", c("image_id") == "", None),
        ("FINAL_NONE_BUT_COMPONENTS_SET", none & ((c("year") != "NONE") | (c("month") != "NONE") | (c("day") != "NONE")), None),
        ("INVALID_DATE_FORMAT", ~none & ~c("__shaped"), None),
        ("COMPONENT_MISMATCH", c("__shaped") & ((c("year") != fy) | (c("month") != fm) | (c("day") != fd)),
         F.concat(F.lit("final("), c("final_date"), F.lit(") != ("), F.concat_ws("-", "year", "month", "day"), F.lit(")"))),
        ("CALENDAR_INVALID", c("__shaped") & ~c("is_real"), F.lit("not a calendar date")),
        ("YEAR_OUTLIER", F.coalesce((c("year_value") < min_year) | (c("year_value") > max_year), F.lit(False)),
         F.concat(c("year_value").cast("string"), F.lit(f" not in [{min_year}, {max_year}]"))),
        ("GT_MISMATCH", has_gt & ~c("gt_equal"),
         F.concat(c("final_date"), F.lit(" vs GT "), c("gt_final_date"), F.lit(" "), reason)),
        ("OCR_HALLUCINATION_OR_MISSING", checked & ~c("token_found"),
         F.concat(c("final_date"), F.lit(" not evidenced in OCR tokens"))))
    # columns of their own for the conditions; lambdas over structs would not be compiled
    rows = rows.withColumns({f"__f{i}": when for i, (_, when, _) in enumerate(flags)})
    types = F.array_compact(F.array(*[F.when(c(f"__f{i}"), F.lit(kind)) for i, (kind, _, _) in enumerate(flags)]))
    messages = [F.when(c(f"__f{i}"), F.lit(kind) if message is None else F.concat(F.lit(kind + ": "), message))
                for i, (kind, _, message) in enumerate(flags)]
    rows = rows.withColumns({"flag_types": types, "flags": F.concat_ws(" | ", *messages)})
    return (rows.withColumns({"num_flags": F.size("flag_types"), "is_clean": F.size("flag_types") == 0})
            .drop("__found", "has_gt", "__shaped", *[f"__f{i}" for i in range(len(flags))]))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Totals of an audit as one row."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    has = lambda *types: F.coalesce(F.sum(sum((F.when(F.array_contains("flag_types", t), 1).otherwise(0) for t in types), F.lit(0))), F.lit(0))
    total, c = F.count("*"), F.col
    pct = lambda x: F.round(x / F.greatest(F.lit(1), total) * 100, 2)
    return audited.agg(
        total.alias("total_images"), n(c("is_clean")).alias("clean_count"), pct(n(c("is_clean"))).alias("clean_ratio"),
        n(~c("is_clean")).alias("flagged_count"), pct(n(~c("is_clean"))).alias("flagged_ratio"),
        n(c("is_real")).alias("valid_dates"), n(c("is_none")).alias("none_dates"),
        has("MISSING_IMAGE_ID", "FINAL_NONE_BUT_COMPONENTS_SET", "INVALID_DATE_FORMAT", "COMPONENT_MISMATCH").alias("syntax_errors"),
        has("CALENDAR_INVALID").alias("calendar_errors"), has("YEAR_OUTLIER").alias("domain_year_outliers"),
        n(c("gt_checked")).alias("gt_evaluated"), n(c("gt_equal")).alias("gt_exact_matches"),
        n(c("gt_checked") & ~c("gt_equal")).alias("gt_mismatches"), n(c("token_checked")).alias("token_evaluated"),
        n(c("token_checked") & ~c("token_found")).alias("token_hallucinations"),
        n(c("token_found")).alias("token_confirmed"))


def audit_breakdown(audited: DataFrame) -> DataFrame:
    """Counts per flag type and per year, as (kind, name, count)."""
    flags = audited.select(F.explode("flag_types").alias("name")).groupBy(F.lit("flag").alias("kind"), "name").agg(
        F.count("*").alias("count"))
    years = audited.filter("year_value IS NOT NULL").groupBy(
        F.lit("year").alias("kind"), F.col("year_value").cast("string").alias("name")).agg(F.count("*").alias("count"))
    return flags.unionByName(years)


# --- submission checks ---------------------------------------------------------------------------

REQUIRED_COLUMNS = ["image_id", "year", "month", "day", "final_date"]


def strict_violation() -> Column:
    """The first rule a submission row breaks, null when it is fine."""
    def part(name: str, width: int, low: int, high: int) -> Column:
        v = F.col(name)
        ok = v.rlike(rf"^\d{{{width}}}$")
        if name != "year":
            ok = ok & v.try_cast("int").between(low, high)
        return F.when((v != "NONE") & ~ok, F.lit(f"Invalid {name}"))
    all_none = (F.col("year") == "NONE") & (F.col("month") == "NONE") & (F.col("day") == "NONE")
    expected = F.when(all_none, "NONE").otherwise(F.concat_ws("-", "year", "month", "day"))
    return F.coalesce(part("year", 4, 0, 9999), part("month", 2, 1, 12), part("day", 2, 1, 31),
                      F.when(F.col("final_date") != expected, F.concat(F.lit("Expected final_date "), expected)))


def submission_check_strict(df: DataFrame, line: str = "line") -> DataFrame:
    """One row: row count and the first bad line with its message (null when the file is fine).

    ``line`` is the line number of each row in the file.
    """
    columns = [c for c in df.columns if c != line]
    if columns != REQUIRED_COLUMNS:
        raise ValueError(f"Invalid columns: {columns}, expected {REQUIRED_COLUMNS}")
    v = df.withColumn("__v", strict_violation())
    bad = F.col("__v").isNotNull()
    return v.agg(F.count("*").alias("rows"), F.sum(F.when(bad, 1).otherwise(0)).alias("violations"),
                 F.min(F.when(bad, F.col(line))).alias("first_bad_line"),
                 F.min_by("__v", F.when(bad, F.col(line))).alias("first_message"),
                 (F.count("*") == 0).alias("is_empty"))


def submission_check_lenient(df: DataFrame, line: str = "line", limit: int | None = None) -> DataFrame:
    """All violations in file order with their total; the older year-missing form is accepted.

    ``limit`` lists only the first ones; ``total`` still counts all.
    """
    c = F.col
    parts = F.split("final_date", "-")
    form = (F.when((c("final_date") == "NONE") & ((c("year") != "NONE") | (c("month") != "NONE") | (c("day") != "NONE")),
                   "final_date is NONE but year/month/day is not NONE")
            .when(c("final_date") == "NONE", None)
            .when(c("final_date").rlike(STRICT_DATE) & ((c("year") != parts[0]) | (c("month") != F.get(parts, F.lit(1)))
                                                       | (c("day") != F.get(parts, F.lit(2)))),
                  "final_date does not match components")
            .when(c("final_date").rlike(STRICT_DATE) | c("final_date").rlike(YEAR_MISSING), None)
            .otherwise("invalid final_date format"))
    messages = F.array_compact(F.array(F.when(c("image_id") == "", "missing image_id"), form))
    found = df.select(line, F.posexplode(messages).alias("__i", "message"))
    total = found.agg(F.count("*").alias("total"))      # one row
    listed = found.orderBy(line, "__i")
    return (listed if limit is None else listed.limit(limit)).crossJoin(F.broadcast(total)).select(line, "message", "total")


def numbered_lines(df: DataFrame, *order: str) -> DataFrame:
    """CSV line numbers (the header is line 1) in the given order."""
    return with_global_index(df, *order).withColumn("line", F.col("row_index") + 2).drop("row_index")


# --- id checks -----------------------------------------------------------------------------------

def coverage_check(ids: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids without image or label, as (image_id, missing)."""
    miss = lambda have, what: ids.select("image_id").join(have.select("image_id").distinct(), "image_id", "left_anti").select(
        "image_id", F.lit(what).alias("missing"))
    return miss(images, "image").unionByName(miss(labels, "label"))


def coverage_ready(ids: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    n = lambda what: F.coalesce(F.sum(F.when(F.col("missing") == what, 1).otherwise(0)), F.lit(0))
    return coverage_check(ids, images, labels).agg(
        n("image").alias("missing_images"), n("label").alias("missing_labels"), (F.count("*") == 0).alias("ready"))


def duplicate_ids(df: DataFrame, key: str = "image_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count")).filter("count > 1")


def id_set_equality(left: DataFrame, right: DataFrame, expected_rows: int | None = None, key: str = "image_id") -> DataFrame:
    """Do two tables hold exactly the same ids, once each. One row."""
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    j = side(left, "l").join(side(right, "r"), key, "full")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    c = F.col
    only_l, only_r = n(c("r").isNull()), n(c("l").isNull())
    rows = F.coalesce(F.sum("l"), F.lit(0))
    ok = (only_l == 0) & (only_r == 0) & (n(c("l") > 1) == 0) & (n(c("r") > 1) == 0)
    if expected_rows is not None:
        ok = ok & (rows == expected_rows)
    return j.agg(only_l.alias("only_left"), only_r.alias("only_right"), n(c("l") > 1).alias("duplicated_left"),
                 n(c("r") > 1).alias("duplicated_right"), rows.alias("left_rows"), ok.alias("equal"))


def split_leakage(splits: DataFrame, everything: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """Overlap counts between splits (image_id, split), against all ids and an evaluation set.

    One pass turns every id into its set of splits; only counts per distinct set remain.
    """
    ids = splits.select("image_id", "split").unionByName(everything.select("image_id", F.lit("~all").alias("split")))
    if evaluation is not None:
        ids = ids.unionByName(evaluation.select("image_id", F.lit("~eval").alias("split")))
    sets = ids.groupBy("image_id").agg(F.array_sort(F.collect_set("split")).alias("s")).groupBy("s").agg(
        F.count("*").alias("n"))
    names = F.filter("s", lambda x: ~x.startswith("~"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(
        F.filter(names, lambda b: b > a), lambda b: F.concat(a, F.lit("_"), b))))
    has = lambda x: F.array_contains("s", x)
    extra = F.array_compact(F.array(
        F.when(F.size(names) > 0, F.lit("union")), F.when(has("~all") & (F.size(names) == 0), F.lit("unassigned")),
        F.when(has("~eval") & ~has("~all"), F.lit("eval_outside"))))
    evals = F.when(has("~eval"), F.transform(names, lambda a: F.concat(F.lit("eval_"), a))).otherwise(
        F.array().cast("array<string>"))
    return (sets.select(F.explode(F.concat(pairs, extra, evals)).alias("measure"), "n")
            .groupBy("measure").agg(F.sum("n").alias("ids")))


def duplicate_metric_groups(leaderboard: DataFrame, columns: tuple[str, ...] = ("final_em", "candidate_recall", "selection_acc"),
                            top: int = 5) -> DataFrame:
    """The largest groups of rows with identical metrics."""
    return leaderboard.groupBy(*columns).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *columns).limit(top)


def rank_sequence_valid(leaderboard: DataFrame, rank: str = "rank") -> DataFrame:
    """Are the ranks exactly 1..n."""
    return leaderboard.agg((F.coalesce(F.count("*") == F.max(rank), F.lit(True)) & F.coalesce(F.min(rank) == 1, F.lit(True))
                            & (F.count_distinct(rank) == F.count("*"))).alias("rank_sequence_valid"))


def dataset_manifest(files: DataFrame, expected: int | None = None) -> DataFrame:
    """Image count, extensions and whether the count is as expected. ``files`` has path, extension."""
    n = F.count("*")
    return files.agg(n.alias("image_count"), F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("extensions"),
                     (F.lit(True) if expected is None else n == expected).alias("count_ok"))


def candidate_folders(files: DataFrame, minimum: int, maximum: int) -> DataFrame:
    """Folders whose number of images lies between the bounds."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("images")).filter(
        F.col("images").between(minimum, maximum))
