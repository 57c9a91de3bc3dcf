import corpus_pipeline as P
from expirylens.llm import decontamination, simhash, tokens
from expirylens.llm.common import materialise


def test_stages_filter_and_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(materialise(stage(spark, tables[-1], sf)))
    for before, after in zip(tables[:-2], tables[1:-1], strict=True):
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert tables[4].count() == tables[3].count() and tables[1].count() > 0.8 * docs.count()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.contaminated(tables[3], items).count() == 0
    texts = [r.text for r in tables[2].collect()]
    assert len(set(texts)) == len(texts)
    encoder = tokens.Encoder(tokens.default_path())
    packed = tables[5].collect()
    assert sum(r.length for r in packed) == sum(len(encoder.encode([r.text or ""])[0]) + 1 for r in tables[4].collect())
    assert P.run(spark, sf).count() == len(packed)


def test_near_copies_leave_one(spark):
    base = [f"word{k}" for k in range(300)]
    near = base[:100] + ["other"] + base[101:]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (9, " ".join(base)), (4, "something else altogether in a few words"), (None, None), (4, "something else altogether in a few words")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.keep_one_of_each(spark, df, "").collect()) == ["3", "4", "None"]


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in P.STAGES:
            docs = materialise(stage(spark, docs, sf))
        assert (docs.count() > 0) == (start is odd_docs)


def test_threshold_of_similarity():
    assert simhash.differing_bits(1.0, 512) == 0 and 70 < simhash.differing_bits(0.8, 512) < 85


def test_filters_decide_by_row(spark, tmp_path):
    """Null and repeated ids: only the toxic, contaminated or copied row goes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = ["garden", "window", "paper", "cloud", "bread", "river", "stone", "lamp"]
    clean = [(i, " ".join(words[(i * k + k // 7) % 8] for k in range(1, 40))) for i in range(400)]
    toxic = [(1000 + i, " ".join(["you", "idiot", "pathetic", "moron"] * 4 + [words[(i * k) % 8] for k in range(1, 20)])) for i in range(400)]
    item = "seven orange clouds drift slowly over the quiet garden wall tonight"
    mixed = [(None, toxic[5][1]), (None, clean[5][1]), (77, toxic[6][1]), (77, clean[6][1]), (None, item), (88, item), (88, clean[7][1])]
    spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + toxic], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def rows(some):
        return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], schema)

    def left(df):
        return sorted([(str(r.doc_id), r.text) for r in df.collect() if r.doc_id in (None, 77, 88)])

    def named(some):
        return sorted((str(i), t) for i, t in some)

    some = mixed[:4]
    kept = [r for r in some if "idiot" not in r[1]]
    assert left(P.drop_toxic(spark, rows([c for c in clean if c[0] not in (77, 88)] + toxic + some), str(tmp_path))) == named(kept)
    assert left(P.drop_benchmark(spark, rows(mixed), str(tmp_path))) == named(r for r in mixed if r[1] != item)
    far = [" ".join(f"{name}{k}" for k in range(60)) for name in "abc"]
    copies = [(None, far[0]), (None, far[0] + " end"), (5, far[1]), (6, far[1] + " end"), (6, far[2]), (6, "not like any of the others at all")]
    got = named((r.doc_id, r.text) for r in P.keep_one_of_each(spark, rows(copies), "").collect())
    assert got in [named([n, *copies[2:3], *copies[4:]]) for n in copies[:2]]
