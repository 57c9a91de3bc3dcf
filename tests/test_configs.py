"""Nested configurations against a plain walk over dictionaries."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from expirylens.operators import configs as K, selection as S
from expirylens.sources.readers import read_configs

DDL = "id int, config string, settings array<struct<key:string,value:string>>"


def walk(config, changes):
    """Expected configuration, or the first key that can't be set."""
    if not isinstance(config, dict) and changes:
        return changes[0][0]
    for key, value in changes:
        *above, leaf = key.split(".")
        at = config
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                return key
        at[leaf] = json.loads(value) if value is not None else None
    return config


def run(spark, cases):
    rows = spark.createDataFrame([(i, c, ch) for i, (c, ch) in enumerate(cases)], DDL).select(
        "id", F.try_parse_json("config").alias("config"),
        F.transform("settings", lambda s: F.struct(s.key.alias("key"), F.parse_json(s.value).alias("value"))).alias("settings"))
    out = K.with_settings(rows, F.col("settings")).select("id", F.to_json("config").alias("c"), "invalid").collect()
    return {r.id: r for r in out}


keys = st.lists(st.sampled_from("ab"), min_size=1, max_size=4).map(".".join)
leaves = st.sampled_from([1, "x", None, [1], 2.5, True])
trees = st.recursive(leaves, lambda t: st.dictionaries(st.sampled_from("ab"), t, max_size=2), max_leaves=6)
case = st.tuples(st.dictionaries(st.sampled_from("ab"), trees, max_size=2),
                 st.lists(st.tuples(keys, st.sampled_from(["1", '"t"', '{"a":{"b":3}}', "null", None])), max_size=3))


@settings(max_examples=4, deadline=None)
@given(st.lists(case, min_size=40, max_size=60))
def test_settings_equal_a_walk(spark, cases):
    got = run(spark, [(json.dumps(c), ch) for c, ch in cases])
    for i, (config, changes) in enumerate(cases):
        want = walk(json.loads(json.dumps(config)), changes)
        if isinstance(want, str):
            assert (got[i].c, got[i].invalid) == (None, want)
        else:
            assert got[i].invalid is None and json.loads(got[i].c) == want, (config, changes)


def test_odd_configurations(spark):
    got = run(spark, [(None, [("a", "1")]), ("not json", [("a", "1")]), ("[1]", [("a", "1")]), ('{"a":1}', None), ('{"a":1}', []),
                      ('{"a":1}', [(None, "1")]), ("{}", [("", "1")]), ('{"a":{"b":1}}', [("a", "7"), ("a.b", "1")])])
    assert [got[i].invalid for i in range(8)] == ["a", "a", "a", None, None, "", None, "a.b"]
    assert got[3].c == got[4].c == '{"a":1}' and got[6].c == '{"":1}' and got[7].c is None


def test_component_spec(spark):
    texts = ['{"s":"p"}', '{"s":{"plugin":"q","params":{"w":1}}}', '{"s":{"params":{"w":1}}}', "{}", '{"s":null}', '{"s":{}}', '{"s":""}',
             '{"s":{"plugin":null}}', '{"s":{"plugin":7}}', '{"s":[1]}', '{"s":3}', '{"s":{"plugin":"q","params":[1]}}', '{"s":0.0}', "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select(
        "id", K.component_spec(F.parse_json("t"), "s", "d").alias("c")).select("id", "c.plugin", F.to_json("c.params").alias("p"), "c.invalid")
    got = {r.id: (r.plugin, r.p, r.invalid is not None) for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == [
        ("p", "{}", False), ("q", '{"w":1}', False), ("d", '{"w":1}', False), ("d", "{}", False), ("d", "{}", False), ("d", "{}", False),
        ("d", "{}", False), ("None", "{}", False), ("7", "{}", False), (None, None, True), (None, None, True), (None, None, True),
        ("d", "{}", False), (None, None, True)]


def test_sweep_and_reader(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"selector": "x", "n": 1}')
    (tmp_path / "empty.json").write_text(" \n")
    (tmp_path / "bad.json").write_text("{")
    configs = read_configs(spark, str(tmp_path))
    out = K.sweep(configs, {"n": ["1", "2"], "m.k": ['"a"', '"b"']}).select("name", "variant_index", F.to_json("config").alias("c"), "invalid")
    got = {(r.name, r.variant_index): (r.c, r.invalid) for r in out.collect()}
    assert len(got) == 12 and got["one", 2] == ('{"m":{"k":"a"},"n":2,"selector":"x"}', None)
    assert got["empty", 3] == ('{"m":{"k":"b"},"n":2}', None) and got["bad", 0] == (None, "n")
    assert K.sweep(configs, {}).count() == 3


def test_a_weight_needs_its_own_path():
    assert S.with_overrides(S.ScoreParams(), **{"selector.params.keyword_weight": 9.0}).keyword_weight == 9.0
    assert S.with_overrides(S.ScoreParams(), **{"params.keyword_weight": 9.0, "position_weight": 2.0}).position_weight == 2.0
    for path in ("a.b.keyword_weight", "selector.keyword_weight", "selector.params.x.keyword_weight"):
        with pytest.raises(ValueError):
            S.with_overrides(S.ScoreParams(), **{path: 9.0})
