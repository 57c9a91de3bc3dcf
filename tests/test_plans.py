"""The physical plans stay the ones we want."""

import contextlib
import io

from pyspark.sql import functions as F

from expirylens.operators import selection as S
from expirylens.operators.candidates import token_candidates
from expirylens.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_token_pass_is_one_narrow_stage(spark):
    p = plan(token_candidates(X.tokens(spark, SF), True, True).select("image_id", "year"))
    assert "Exchange" not in p and "Python" not in p
    assert p.count("regexp_replace(t") <= 20         # every pattern is evaluated once
    schema = next(line for line in p.splitlines() if line.startswith("ReadSchema"))
    assert "text" in schema and not any(c in schema for c in ("bbox", "confidence", "source"))


def test_selection_prunes_groups_before_the_shuffle(spark):
    p = plan(S.select_best(X.scored(spark, SF)))
    assert p.count("WindowGroupLimit") >= 2 and "Python" not in p and "CartesianProduct" not in p


def test_features_use_keyed_joins_only(spark):
    p = plan(S.features(X.candidates(spark, SF), X.tokens(spark, SF)))
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "Python" not in p


def test_filters_reach_the_scan(spark):
    p = plan(X.tokens(spark, SF).filter(F.col("source") == "yolo").select("image_id"))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,yolo)]" in p
