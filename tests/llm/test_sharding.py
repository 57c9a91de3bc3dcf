from collections import Counter

import pytest

from expirylens.llm.sharding import jump_shard, shard

M = (1 << 64) - 1


def jump(key, shards):
    key, b, j = key & M, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & M
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 1000])
def test_jumps_follow_the_published_walk(spark, shards):
    keys = [0, 1, -1, 2, 12345678901234567, -(1 << 63), (1 << 63) - 1, *range(1000, 1100)]
    at, grown = jump_shard(spark.range(1)["id"], 3), None
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    at, grown = jump_shard(df["k"], shards)
    got = {r.k: (r.at, r.grown) for r in df.select("k", at.alias("at"), grown.alias("grown")).collect()}
    assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_odd_rows_and_slots(spark, odd_docs, no_docs):
    rows = shard(odd_docs, "doc_id", 3).collect()
    assert len(rows) == odd_docs.count()
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.shard == jump(r.doc_id or 0, 3) and r.grown_shard in (r.shard, 3) for r in rows)
    assert {r.count for r in [r.asDict().get("label") and r for r in rows] if r} and rows[0]["part"] == "clash"
    assert shard(no_docs, "doc_id", 3).count() == 0
    assert shard(odd_docs, "text", 5).count() == odd_docs.count()
    with pytest.raises(ValueError):
        shard(no_docs, "doc_id", 0)


def test_a_hot_key_gets_gap_free_slots(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 7L, id) AS doc_id").repartition(6)
    rows = shard(df, "doc_id", 4).collect()
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_the_query(spark, sf):
    import zlib

    from expirylens.llm.queries import QUERIES
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_sharding"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.shard, r.grown_shard, r.law) == (len(data) + 16, zlib.crc32(data), jump(r.doc_id, 40), jump(r.doc_id, 41), "key")
