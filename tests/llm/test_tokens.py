import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from expirylens.llm import huffman, packing
from expirylens.llm.common import shared_folder
from expirylens.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from(list("ab,.'éß0 \n\t  \x1c!İ漢😀")), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_whole_texts(texts):
    encoder = test_words_give_the_ids_of_whole_texts.__dict__.setdefault("encoder", None) or Encoder(default_path())
    test_words_give_the_ids_of_whole_texts.encoder = encoder
    assert [x.tolist() for x in encoder.encode(texts)] == [plain(encoder, t) for t in texts]


def test_special_strings_are_text(encoder):
    assert encoder.encode(["a <|endoftext|> b"])[0].tolist() == plain(encoder, "a <|endoftext|> b")
    assert 50256 not in encoder.encode(["<|endoftext|>"])[0]


@pytest.mark.parametrize("longest", [1, 8, 1024])
def test_pieces(longest):
    n = np.arange(1, 5000, 7)
    at, size, start = packing.pieces_of(n, longest)
    for i, total in enumerate(n.tolist()):
        own, starts = size[at == i].tolist(), start[at == i].tolist()
        rest = total % longest
        assert own == [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        assert starts == [sum(own[:k]) for k in range(len(own))]


def check_packing(spark, encoder, docs, rows):
    texts = docs.select("doc_id", "text").collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.length for r in rows)
    assert all(r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    want = sorted(sum((np.append(plain(encoder, t.text or ""), 0).tolist() for t in texts), []))
    assert sorted(np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist()) == want
    for i in {t.doc_id for t in texts}:
        if sum(t.doc_id == i for t in texts) == 1:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            ids = np.append(plain(encoder, next(t.text for t in texts if t.doc_id == i) or ""), 0)
            assert b"".join(r.ids for r in own) == ids.astype("<u4").tobytes()
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and own[0].doc_tokens == len(ids)


def test_packing(spark, encoder, odd_docs, no_docs, sf):
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        check_packing(spark, encoder, docs, packing.pack(docs, default_path()).collect())
    assert packing.pack(no_docs, default_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_docs, default_path(), longest=1000)


def test_code_lengths_are_optimal_and_limited():
    import heapq
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (7, 3), (200, 16), (300, 9)):
        counts = np.concatenate([rng.zipf(1.3, n).clip(max=10**9), [0, 0]])
        lengths = huffman.code_lengths(counts, limit)
        assert lengths[-1] == 0 and lengths.max() <= limit
        assert n == 1 or sum(2.0 ** -x for x in lengths if x) == 1
        heap, cost = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        if limit == 16 and n > 1:
            free = huffman.code_lengths(counts, 40)
            assert int((free * counts).sum()) == cost
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


@given(st.lists(st.integers(0, 400), min_size=1, max_size=1500))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip_from_any_checkpoint(ids):
    tokens = np.array(ids)
    lengths = huffman.code_lengths(np.bincount(tokens), 16)
    bits, checkpoints = huffman.encode_block(tokens, huffman.canonical_codes(lengths), lengths)
    table = huffman.decode_table(lengths)
    assert huffman.decode_block(bits, checkpoints, len(tokens), table).tolist() == ids
    k = len(checkpoints) // 2
    assert huffman.decode_block(bits, checkpoints[k:], len(tokens) - 128 * k, table).tolist() == ids[128 * k:]


def test_files_round_trip(spark, encoder, odd_docs, no_docs, sf, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 700)
    for docs in (odd_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        path = shared_folder(spark)
        huffman.write_tokens(docs, path, default_path())
        rows = sorted(huffman.read_tokens(spark, path).collect(), key=lambda r: r.start)
        texts = docs.select("doc_id", "text").collect()
        assert len(rows) == len(texts)
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        want = sorted((str(t.doc_id), zlib.crc32(np.append(plain(encoder, t.text or ""), 2).astype("<u4").tobytes())) for t in texts)
        assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in rows) == want
        assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
        assert all(4 * r.n_tokens == len(r.ids) for r in rows)
    path = shared_folder(spark)
    huffman.write_tokens(no_docs, path, default_path())
    assert huffman.read_tokens(spark, path).count() == 0
