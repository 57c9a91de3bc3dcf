"""The date grammar on fixed vectors."""

from pyspark.sql import functions as F

from expirylens.functions import dates as D, text as T
from expirylens.operators.candidates import extract_candidates

BASIC = {"2026.10.14": "2026-10-14", "26-10-14": "2026-10-14", "10/14": "NONE-10-14", "20261014": "2026-10-14",
         "261014": "2026-10-14", "2026년 3월 7일": "2026-03-07", "3월 7일": "NONE-03-07", "10.14 09:45 PM": "NONE-10-14",
         "2021:04:13": "2021-04-13", "EXP 2027.O1.14": "2027-01-14", "13.32": None, "2026.02.31": None, "209.10.29": None,
         "31-03-2022": None, "2000.02.30": None, "0000.01.01": None}
EXTENDED = {"31-03-2022": "2022-03-31", "BEST BEFORE:21-04-2023": "2023-04-21", "OCT.21.2021": "2021-10-21", "04/2023": "2023-04-NONE",
            "2022 08 03": "2022-08-03", "12 09 2021": "2021-09-12", "SEP 18 2021": "2021-09-18", "29/SEP/2022": "2022-09-29",
            "2021.1217": "2021-12-17", "15FEB22": "2022-02-15", "29.Jan.2024": "2024-01-29", "13/03/22": "2022-03-13",
            "28/02/22": "2022-02-28", "20.06.25": "2020-06-25", "2022.03.05": "2022-03-05", "16/07/2026": "2026-07-16",
            "05.20.24": "2024-05-20", "11122021": "2021-12-11", "14.10.2026LOT": "2026-10-14", "15OCT2026": None}


def first_candidates(spark, texts, **flags):
    t = spark.createDataFrame([(x, 0, x, 0.9) for x in texts], "image_id string, token_index int, text string, confidence double")
    c = extract_candidates(t, **flags).withColumn("final", D.candidate_final_date(
        F.col("year"), F.col("month"), F.col("day"), F.col("calendar_valid"), "NONE", "NONE"))
    rows = c.groupBy("image_id").agg(F.min_by("final", "cand_ordinal").alias("final")).collect()
    return {r.image_id: r.final for r in rows}


def test_basic_formats(spark):
    got = first_candidates(spark, BASIC)
    assert {k: got.get(k) for k in BASIC} == BASIC


def test_day_first_and_month_names(spark):
    got = first_candidates(spark, EXTENDED, day_first=True, month_names=True)
    assert {k: got.get(k) for k in EXTENDED} == EXTENDED


def test_all_white_space_counts(spark):
    got = first_candidates(spark, ["2026 10　14", "　2026.10.14 "])
    assert set(got.values()) == {"2026-10-14"}


def test_overlap_order_and_labels(spark):
    t = spark.createDataFrame([("a", 0, "EXP 2026.10.14 / 10.14 x 21-12-28까지", 0.9), ("b", 0, "2026.10.14A123", 0.9)],
                              "image_id string, token_index int, text string, confidence double")
    rows = extract_candidates(t).orderBy("image_id", "cand_ordinal").collect()
    assert [(r.image_id, r.raw_text, r.pattern) for r in rows] == [
        ("a", "2026.10.14", "ymd_separated"), ("a", "10.14", "md_separated"), ("a", "21-12-28", "ymd_separated"),
        ("b", "2026.10.14", "ymd_separated"), ("b", "2026.10.14", "ymd_lot_attached")]


def test_keep_invalid_and_dedup(spark):
    t = spark.createDataFrame([("a", 0, "2026.02.31 and 2026.02.31 or 2026.02.28", 0.9)],
                              "image_id string, token_index int, text string, confidence double")
    assert [r.day for r in extract_candidates(t, keep_invalid=True).orderBy("cand_ordinal").collect()] == ["31", "28"]
    assert [r.day for r in extract_candidates(t).collect()] == ["28"]


def test_split_tokens_are_joined(token_table):
    t = token_table({"s": ["2026년", "3월", "7일"], "g": [("2027.", 0.9, (100, 10, 140, 30)), ("10.", 0.7, (145, 11, 170, 30)),
                                                         ("14", 0.5, (175, 10, 195, 30)), ("제조일", 0.9, (100, 80, 145, 100))],
                     "full": ["2026.01.02", "3월", "7일"]})
    got = {r.image_id: r for r in extract_candidates(t).collect()}
    assert (got["s"].year, got["s"].month, got["s"].day, got["s"].joined) == ("2026", "03", "07", True)
    assert got["g"].token_indices == [0, 1, 2] and got["g"].raw_text == "2027. 10. 14"
    assert abs(got["g"].recognition_confidence - 0.7) < 1e-12
    assert not got["full"].joined


def test_parse_final_date_vocabulary(spark):
    cases = {"2026-10-14": ("2026", "10", "14"), "NoNE-10-14": (None, "10", "14"), "NONE-10-14": (None, "10", "14"),
             "2026-10-None": ("2026", "10", None), "2026-10-NONE": ("2026", "10", None), "NONE": None, "": None, " none ": None,
             "2026-13-45": ("2026", "13", "45"), "2026.10.14": ("2026", "10", "14"), "26.1.2": ("2026", "01", "02"), "junk": None,
             "3월 7일": (None, "03", "07"), "2026.02.31": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("k", D.parse_final_date("t"))
    assert {r.t: tuple(r.k) if r.k else None for r in df.collect()} == cases


def test_requested_pattern_keeps_its_name(spark):
    df = spark.createDataFrame([("2026.10.14", "ymd_lot_attached"), ("2026.10.14", ""), ("nothing", "")], "t string, p string")
    rows = df.select(D.parse_date_text("t", "ymd_lot_attached").alias("a"), D.parse_date_text("t", "p", pattern_column=True).alias("b")).collect()
    assert rows[0].a.pattern == "ymd_lot_attached" and rows[0].b.pattern == "ymd_lot_attached"
    assert rows[1].b.pattern == "ymd_separated" and rows[2].a is None


def test_sanitizer_modes(spark):
    raw = "EXP: 2027.10.14???"
    df = spark.createDataFrame([(raw, "소비기한", "2027.10.O1???")], "a string, k string, n string")
    r = df.select(T.sanitize_text(F.col("a"), "soft"), T.sanitize_text(F.col("k"), "date_context"), T.sanitize_text(F.col("a"), "date_context"),
                  T.sanitize_text(F.col("n"), "numeric_date"), T.sanitize_text(F.col("k"), "numeric_date")).first()
    assert tuple(r) == ("EXP: 2027.10.14", "소비기한", "EXP: 2027.10.14", "2027.10.O1", "소비기한")
    try:
        T.sanitize_text(F.col("a"), "other")
        assert False
    except ValueError:
        pass


def test_confusions_only_inside_numeric_spans(spark):
    cases = {"EXP 2027.O1.14": "EXP 2027.01.14", "Oil company": "011 company", "LOT": "LOT", "l5/1O": "15/10", "a|b": "a|b"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("c", T.correct_numeric_confusions(F.col("t")))
    assert {r.t: r.c for r in df.collect()} == cases


def test_loose_readers(spark):
    df = spark.createDataFrame([("2021 . 3-4",), ("15 FEB 2022",), ("2021OCT05",), ("2024년 2월 30일",), ("24.2.29",), (None,)], "t string")
    got = [(r[0], r[1]) for r in df.select(D.normalize_simple(F.col("t")), D.normalize_validated(F.col("t"))).collect()]
    assert got[4:] == [("2024-02-29", "2024-02-29"), (None, None)]
    assert got[1][1] == "2022-02-15" and got[2][1] == "2021-10-05" and got[3][1] is None


def test_calendar(spark):
    df = spark.createDataFrame([("2024", "2", "29"), ("2023", "02", "29"), (None, "02", "29"), ("2023", "13", None), ("2023", "12", None), ("x", "1", "1")],
                               "y string, m string, d string")
    assert [r[0] for r in df.select(D.calendar_valid(F.col("y"), F.col("m"), F.col("d"))).collect()] == [True, False, True, False, True, False]
