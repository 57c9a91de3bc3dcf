"""Work that follows the different texts, not the rows; files that do not grow with the entries."""

import datetime as dt
import itertools

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from expirylens.functions import dates as D
from expirylens.operators import boxes as B, search as Q, selection as S
from expirylens.plans import catalog, fixtures as X
from expirylens.sources import readers as I, writers as O


def test_parsed_texts_has_one_row_for_each_text(spark):
    texts = ["2024.01.02", "05/03/2025", "O5MAR2025", "LOT", "soil", "", None, "2024.02.31"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 50)], "id int, text string")
    known = D.parsed_texts(t, "text", True, True)
    plain = t.withColumn("p", D.parse_date_text("text", "", True, True)).filter("p IS NOT NULL").select("id", "text", "p.*")
    assert known.count() == plain.select("text").distinct().count() < plain.count()
    joined = t.join(known, "text").select("id", "text", "p.*")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def _files(path):
    return [f for f in path.rglob("part-*") if f.is_file()]


def test_run_table_reads_as_run_folders_with_files_that_do_not_grow(spark, tmp_path):
    runs = spark.range(300).select(F.concat(F.lit("run_"), "id").alias("run"), F.col("id").alias("image_count"), (F.col("id") / 7).alias("candidate_recall"),
                                   F.when(F.col("id") % 2 == 0, "/x/set").alias("input_dir"), (F.col("id") % 3 == 0).alias("tokens_cache_used"),
                                   F.struct(F.col("id").cast("string").alias("name")).alias("config")).coalesce(4)
    metrics, manifest = runs.select("run", "image_count", "candidate_recall"), runs.select("run", "input_dir", "tokens_cache_used", "config")
    O.write_run_table(metrics, manifest, str(tmp_path / "table"))
    O.write_metrics(metrics.limit(20), str(tmp_path / "folders"), manifest)
    columns = ["run_name", "image_count", "candidate_recall", "input_dir", "tokens_cache_used", "config_name"]
    table = I.read_run_table(spark, str(tmp_path / "table")).select(*columns)
    assert table.count() == 300 and len(_files(tmp_path / "table")) <= 16
    folders = I.read_runs(spark, str(tmp_path / "folders")).withColumn("run_name", F.regexp_replace("run_name", "^run=", "")).select(*columns)
    assert folders.count() == 20 and folders.exceptAll(table).count() == 0


def test_sidecar_lines_keep_names_and_positions(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("img_"), "id", F.lit(".png.ocr.json")).alias("name"), F.to_json(F.array(
        F.struct(F.lit("a\tb\nc").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.col("id").cast("string").alias("text"), F.lit(0.25).alias("confidence")))).alias("value"))
    O.write_sidecar_lines(rows.coalesce(4), str(tmp_path / "lines"))
    assert len(_files(tmp_path / "lines")) <= 4
    got = I.read_token_sidecar_lines(spark, str(tmp_path / "lines")).select("image_id", "token_index", "text").collect()
    assert sorted(map(tuple, got)) == sorted([(f"img_{i}", 0, "a\tb\nc") for i in range(200)] + [(f"img_{i}", 1, str(i)) for i in range(200)])


def test_only_weights_that_count_are_evaluated_and_near_ties_exactly():
    r = np.random.default_rng(7)
    names = list(S.WEIGHT_NAMES)
    combos = [{n: getattr(S.ScoreParams(), n) for n in names} | c for c in Q.product_grid(Q.DEFAULT_GRID)]
    weights = np.array([[float(c[n]) for n in names] for c in combos])
    sizes = r.integers(2, 5, 200)
    # few values, so that many scores differ by rounding only
    f = {n: r.choice([0.0, 0.1, 0.2, 0.3], sizes.sum()) for n in S.FEATURE_COLUMNS}
    for n in ("calendar", "is_partial", "is_time_like", "source_prior", "negative_keyword"):
        f[n] = np.ones(sizes.sum())
    f["is_correct"] = r.integers(0, 2, sizes.sum()).astype(float)
    cells = [0]

    def counted(w, x):
        s = Q._linear_score(w, x)
        cells[0] += s.size
        return s
    Q._PARTS[counted] = Q._PARTS[Q._linear_score]
    try:
        fast = Q._right_images(counted, names, weights, f, sizes)
        few, cells[0] = cells[0], 0
        assert fast.tolist() == Q._right_images_exactly(counted, names, weights, f, sizes).tolist()
        assert few * 5 < cells[0]
    finally:
        del Q._PARTS[counted]


def test_a_mean_at_the_threshold_is_not_low_in_any_order(spark):
    steps = [c for c in itertools.product(range(0, 11), repeat=5) if sum(c) == 15][::9]       # 0.5 + 0.04 x, mean 0.62
    rows = [(f"i{i}", round(0.5 + x * 0.04, 6)) for i, c in enumerate(steps) for x in c]
    assert any(sum(round(0.5 + x * 0.04, 6) for x in c) / 5 < 0.62 for c in steps)
    tokens = spark.createDataFrame(rows + [("low", 0.61), ("nan", float("nan")), ("null", None)], "image_id string, confidence double")
    images = tokens.select("image_id").distinct().unionByName(spark.createDataFrame([("bare",)], "image_id string"))
    assert {r.image_id for r in B.low_confidence_images(tokens, images, 0.62).collect()} == {"low", "null", "bare"}


def _orders(spark, folder, dates):
    """The order tables for {order key: dates of its lines} and a connection that sees them."""
    day = lambda text: dt.datetime.fromisoformat(text) - dt.timedelta(days=X.SHIFT_DAYS)
    lines = [(k, 1, 1, i, 1.0, 1.0, 0.05, 0.01, "N", "O", day(d)) for k, ds in dates.items() for i, d in enumerate(ds)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(folder / "lineitem.parquet"))
    spark.createDataFrame([(k, "O", day("2020-01-01")) for k in dates], "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(str(folder / "orders.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    catalog.load_all()
    return con


def test_agreement_counts_every_reading_in_query_and_sql(spark, tmp_path):
    con = _orders(spark, tmp_path, {1: ["2021-02-20", "2020-11-24", "2024-01-01"], 2: ["2022-05-06", "2021-12-23", "2023-01-02"],
                                    3: ["2023-09-26", "2021-11-25", "2023-07-25", "2025-01-01"]})
    for name, n in (("r19_teacher_agreement", 3), ("r19_teacher_agreement_rate", 1)):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(catalog.ORACLES[name]).fetchall()) and len(got) == n


def test_a_weak_label_below_the_image_has_no_rectangle_in_query_and_sql(spark, tmp_path):
    con = _orders(spark, tmp_path, {1: [f"2021-02-{i:02d}" for i in range(1, 17)], 2: ["2021-02-01", "2022-03-04"]})
    name = "j13_weak_label_matches"
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    assert [r[3:] for r in got] == [(None,) * 4, (164, 34, 256, 64)]


def test_configurations_are_spread_over_the_cores(spark):
    assert X.configs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_documents_between_the_stages_are_packed_tighter(spark):
    kept = corpus_pipeline.with_row_key(spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles()) and kept.count() == 10
