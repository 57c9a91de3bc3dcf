import numpy as np

from expirylens.llm import huffman
from expirylens.llm.common import materialise
from expirylens.llm.tokens import default_path


def test_counts_come_from_the_pass_that_tokenizes(spark):
    texts = [None, "", "a b a", "EXP 2024.01.02"] + [f"word {i} é" for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    stored = materialise(huffman.token_table(docs, default_path()))
    want = np.bincount(np.concatenate([huffman._array(r.wide, r.ids) for r in stored.select("wide", "ids").collect()]))
    got = huffman.token_counts(stored.select("counts"))         # the ids are not read again
    assert got.tolist() == want.tolist()
    assert stored.filter("counts IS NOT NULL").count() <= 3
    assert len(huffman.token_counts(stored.select("counts").limit(0))) == 0
