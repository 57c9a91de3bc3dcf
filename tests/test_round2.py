"""Merged passes, repeated labels, empty images, whole grids, long label parts, three-digit years."""

import json

import pytest
from pyspark.sql import functions as F

from expirylens.operators import audit as A, candidates as C, filters as O, metrics as M, routing as R, search as Q, selection as S
from expirylens.operators.ordering import renumber
from expirylens.schemas import TILE_TOKENS
from expirylens.sources import readers as I


def positions(df):
    out = {}
    for r in df.orderBy("image_id", "token_index").collect():
        out.setdefault(r.image_id, []).append((r.token_index, r.text))
    return out


def test_merged_passes_are_numbered_like_one_list(token_table):
    first = token_table({"a": ["x", "2024.01.02"], "b": ["only"]})
    second = token_table({"a": ["EXP", "y"], "c": ["z"]})
    assert positions(R.merge_passes(first, second)) == {
        "a": [(0, "x"), (1, "2024.01.02"), (2, "EXP"), (3, "y")], "b": [(0, "only")], "c": [(0, "z")]}


def test_a_keyword_in_the_next_pass_is_near(spark, token_table):
    first, second = token_table({"a": ["2024.01.02"]}), token_table({"a": ["EXP"]})
    none = spark.createDataFrame([], "image_id string")
    routed = R.route_tiers(first, second, second.limit(0), none)
    row = S.features(C.extract_candidates(routed), routed).first()
    assert row.positive_keyword == pytest.approx(0.5)


def test_renumbering_of_sparse_positions_over_many_tiles(spark):
    step = TILE_TOKENS // 3
    df = spark.range(50).select(F.lit("a").alias("image_id"), (F.col("id") * step).cast("int").alias("token_index"), F.col("id").cast("string").alias("text"))
    assert positions(renumber(df)) == {"a": [(i, str(i)) for i in range(50)]}


def test_filtering_a_source_closes_up(token_table):
    t = token_table({"a": [("p", 0.9, None, "s1"), ("q", 0.9, None, "s2"), ("r", 0.9, None, "s1")]})
    assert positions(O.filter_source(t, "s2")) == {"a": [(0, "p"), (1, "r")]}


def test_sparse_positions_do_not_spread_over_absent_tiles(spark, token_table):
    t = token_table({"a": ["2024.01.02", "EXP"]}).withColumn("token_index", F.col("token_index") * (1 << 24))
    feats = S.features(C.extract_candidates(t), t)
    assert feats.count() == 1


def test_labels_over_several_lines_and_the_last_of_an_id(spark, tmp_path):
    (tmp_path / "l.csv").write_text('image_id,final_date,text_found\n1,2024-01-01,"a\nb"\n2,NONE,　x　\n1,2025-02-02,"c, ""d"""\n', encoding="utf-8")
    rows = {r.image_id: (r.final_date, r.text_found) for r in I.read_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert rows == {"1": ("2025-02-02", 'c, "d"'), "2": ("NONE", "x")}


def test_repeated_labels_do_not_multiply_rows(spark):
    pred = spark.createDataFrame([("1", "2024", "01", "02", "2024-01-02")], "image_id string, year string, month string, day string, final_date string")
    labels = pred.unionByName(pred.withColumn("final_date", F.lit("2023-01-01")))
    for df in (M.attach_labels(pred, labels), M.default_label_join(pred, labels), M.eval_join(pred, labels)):
        assert df.count() == 1
    assert A.audit_labels(pred, labels).count() == 1


def test_images_without_tokens_count_in_an_audit(spark, tmp_path):
    lines = [{"image_id": "1", "tokens": [{"text": "2024.01.02", "confidence": 0.9}]}, {"image_id": "2", "tokens": []}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n　\n", encoding="utf-8")
    images = I.read_cached_images(spark, str(tmp_path / "t.jsonl"))
    tokens = I.read_token_cache(spark, str(tmp_path / "t.jsonl"))
    assert sorted(r.image_id for r in images.collect()) == ["1", "2"]
    labels = spark.createDataFrame([(i, "2024", "01", "02", "2024-01-02") for i in "123"], "image_id string, year string, month string, day string, final_date string")
    flags = {r.image_id: r.flag_types for r in A.audit_labels(labels, None, tokens, images=images).collect()}
    assert flags == {"1": [], "2": ["OCR_HALLUCINATION_OR_MISSING"], "3": []}


def test_long_label_parts_across_a_tile_cut(spark):
    text = "".join("2024501002"[i] for i in range(10))
    cut = TILE_TOKENS - 5
    tokens = spark.createDataFrame([("1", cut + i, c) for i, c in enumerate(text)], "image_id string, token_index int, text string")
    labels = spark.createDataFrame([("1", "20245", "010", "02")], "image_id string, year string, month string, day string")
    assert A.token_evidence(tokens, labels).first().token_found


def test_all_violations_are_listed_with_their_total(spark):
    rows = [(i, str(i), "2024", "01", "02", "2024/01/02") for i in range(15)]
    df = spark.createDataFrame(rows, "line int, image_id string, year string, month string, day string, final_date string")
    assert A.submission_check_lenient(df).count() == 15
    assert {r.total for r in A.submission_check_lenient(df, limit=3).collect()} == {15}
    with pytest.raises(ValueError):
        A.submission_check_strict(df.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        A.submission_check_strict(df.select("line", "year", "image_id", "month", "day", "final_date"))


def test_lines_are_distinct_over_the_whole_table(spark):
    df = spark.createDataFrame([("1", "abc\nxyz\nabc"), ("2", "new one\n abc \nlast")], "image_id string, text_found string")
    assert sorted(tuple(r) for r in O.explode_label_lines(df).collect()) == [("1", 0, "abc"), ("1", 1, "xyz"), ("2", 0, "new one"), ("2", 1, "last")]


def test_three_digit_years_use_up_their_text(token_table):
    t = token_table({"a": ["209. 03.04.05"], "b": ["03.04.05"]})
    assert {r.image_id for r in C.extract_candidates(t).collect() if r.pattern == "ymd_separated"} == {"b"}


def test_grids_are_whole_unless_limited():
    assert len(Q.product_grid(Q.DEFAULT_GRID)) == 7776
    some = Q.product_grid(Q.DEFAULT_GRID, 2000, strided=True)
    assert len(some) == 2000 and {c["keyword_weight"] for c in some} == {0.3, 0.5, 0.7, 0.9}


def test_match_rules_differ_in_unreadable_labels(spark, token_table):
    tokens = token_table({"a": ["nothing here"], "b": ["2024.01.02"]})
    labels = spark.createDataFrame([("a", "unreadable"), ("b", "2024-01-02")], "image_id string, final_date string")
    plain = Q.evaluate_params(tokens, labels, [{}]).first()
    whole = Q.evaluate_params(tokens, labels, [{}], both_unreadable=True).first()
    assert (plain.correct, whole.correct, plain.total) == (1, 2, 2)


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from expirylens.plans import storage
    unset = SimpleNamespace(conf={})
    monkeypatch.setattr(storage, "_chosen", [])
    with pytest.raises(ValueError):
        storage.shared_folder(unset)
    storage.use_folder("/shared")
    assert storage.shared_folder(unset).startswith("/shared/")
    assert storage.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
