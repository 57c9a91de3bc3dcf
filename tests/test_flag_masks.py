"""One extraction under all settings of the parser flags."""

import random

import pytest

from expirylens.functions.dates import FLAG_PAIRS
from expirylens.operators import search as Q
from expirylens.operators.candidates import annotated_candidates, candidates_under, extract_candidates
from expirylens.plans import fixtures as X
from expirylens.plans.storage import materialise
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


def odd_images():
    r = random.Random(5)
    parts = ["2024.05.06", "05/06/2024", "13.05.2023", "06.2025", "12 MAY 2024", "MAY 12, 2024", "240506", "20240506", "06052024", "05.06",
             "25.12.31", "10/11/22", "31.12.25", "O5.06.2O24", "2024.13.45", "12.31.2024", "exp", "2023년 5월 6일", "5월 6일", "10:30", "1 2 2024", ""]
    images = {f"odd_{i}": [" ".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(1, 4))] for i in range(150)}
    # dates that only lines hold, under some settings or all of them
    for k, pieces in enumerate((["2024", ".05.", "06"], ["12", "MAY", "2024"], ["05", "/06/", "2024"], ["31.", "12.", "2025"], ["7", "x"])):
        images[f"line_{k}"] = [(t, 0.8, (30 * i, 0, 30 * i + 20, 10), "yolo", 0.5) for i, t in enumerate(pieces)]
    images["both"] = [("12", 0.8, (0, 0, 20, 10), None), ("MAY", 0.8, (30, 0, 50, 10), None), ("2024", 0.8, (60, 0, 80, 10), None),
                      ("05.06.2023", 0.7, (0, 90, 80, 99), None)]
    images["null"] = [(None, None, None, None), ("", 0.1, None, None)]
    return images


@pytest.mark.parametrize("keep_invalid", [False, True])
def test_each_setting_equals_its_own_run(spark, token_table, keep_invalid):
    tokens = materialise(token_table(odd_images()).unionByName(X.tokens(spark, SF).limit(0), allowMissingColumns=True))
    annotated = annotated_candidates(tokens, keep_invalid, materialise=materialise)
    counts = []
    for pair in FLAG_PAIRS:
        own = materialise(extract_candidates(tokens, *pair, keep_invalid=keep_invalid, materialise=materialise))
        got = materialise(candidates_under(annotated, *pair))
        assert got.columns == own.columns
        assert got.exceptAll(own).isEmpty() and own.exceptAll(got).isEmpty()
        counts.append((own.count(), own.filter("joined").count()))
    assert len({n for n, _ in counts}) == 4 and counts[0][1] > 0 and len({n for _, n in counts}) > 1


def test_given_tokens_without_a_store_and_empty_tables(spark):
    tokens = X.tokens(spark, SF)
    annotated = annotated_candidates(tokens, join_lines=False)
    for pair in FLAG_PAIRS:
        own = extract_candidates(tokens, *pair, join_lines=False)
        got = candidates_under(annotated, *pair)
        assert own.count() > 500 and got.exceptAll(own).isEmpty() and own.exceptAll(got).isEmpty()
    assert candidates_under(annotated_candidates(tokens.filter("false")), True, True).isEmpty()


def test_the_grammar_stands_once_for_all_settings(spark):
    tokens = X.tokens(spark, SF)
    single = plan(extract_candidates(tokens, True, True, join_lines=False, by_text=True))
    every = plan(annotated_candidates(tokens, join_lines=False))
    assert every.count("regexp_replace(t") == single.count("regexp_replace(t") > 10


def test_sweeps_over_flags_equal_separate_runs(spark, token_table):
    tokens = materialise(token_table(odd_images()))
    labels = spark.createDataFrame([(i, d) for i, d in zip(sorted(odd_images()), ["2024-05-06", "NONE", "2024-05-12", "2023-05-13"] * 60)],
                                   "image_id string, final_date string")
    params = [{"allow_day_first": d, "allow_month_names": m, "keyword_weight": w} for d, m in (FLAG_PAIRS[0], FLAG_PAIRS[3]) for w in (0.1, 0.9)]
    got = {r.combo: r.asDict() for r in Q.evaluate_params(tokens, labels, params).collect()}
    for first in (0, 2):
        own = Q.evaluate_params(tokens, labels, params[first:first + 2]).collect()
        assert len(own) == 2 and all(got[first + r.combo] == r.asDict() | {"combo": first + r.combo} for r in own)
