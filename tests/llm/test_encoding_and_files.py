"""Token files: round trips, and ids equal to the library's on whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import catalog, simple8b
from marketloom.llm.encoding import ChunkEncoder


def whole(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def codes(request):
    return ChunkEncoder(catalog.vocabulary(request.param))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="abcAB don't.,!\n \t éßΩ中12#<|>İ\x00", max_size=40), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(codes, texts):
    for _ in range(2):  # the second time from the cache
        assert codes.encode(texts) == [whole(codes.tokenizer, t) for t in texts]


def test_cache_generations_keep_results(codes, monkeypatch):
    monkeypatch.setattr("marketloom.llm.encoding.CACHE", 3)
    texts = ["one two three four", "five six\nseven", "one  two", "two three"] * 2
    for t in texts:
        assert codes.encode([t, None]) == [whole(codes.tokenizer, t), b""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_words_round_trip(ids):
    words, offsets, raw = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, offsets, len(ids), raw).tolist() == ids


def test_small_ids_share_words():
    words, _, _ = simple8b.encode(np.zeros(1024, np.uint64))
    assert len(words) == 9  # 120 in a word
    assert len(simple8b.encode(np.full(1024, 5, np.uint64))[0]) == 52  # 20 in a word


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_file_of_many_blocks_escapes_and_empty_documents(monkeypatch):
    monkeypatch.setattr(simple8b, "GROUP", 2)
    rng = np.random.default_rng(3)
    docs = [(i if i % 5 else None, rng.integers(0, 1 << int(rng.integers(1, 60)), int(n)).tolist()) for i, n in enumerate(rng.integers(0, 1500, 20))]
    docs[3] = (3, [2**64 - 1, 0, 2**61])
    r = simple8b.Reader(Bytes(simple8b.dumps(docs, "<u8")))
    assert [None if n else int(d) for d, n in zip(r.doc_ids, r.nulls)] == [d for d, _ in docs]
    every = [x for _, ids in docs for x in ids]
    assert r.blocks(0, len(r.offsets) - 1).tolist() == every
    assert r.blocks(2, 3).tolist() == every[2048:3072]  # one block alone
    assert [int(x) for x in r.sizes] == [len(ids) for _, ids in docs]


def test_a_cut_file_is_refused():
    data = simple8b.dumps([(1, [1, 2, 3])])
    with pytest.raises(ValueError):
        simple8b.Reader(Bytes(data[:-1]))


def test_documents_come_back_from_files(spark, odd_docs, no_docs):
    path = catalog.vocabulary("byte_bpe_50k.json")
    tokenizer = ChunkEncoder(path).tokenizer
    got = simple8b.round_trip(odd_docs, path).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    expected = sorted((r.doc_id if r.doc_id is not None else -1, len(b := whole(tokenizer, r.text) + b"\0\0\0\0") // 4, zlib.crc32(b)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == expected
    by_start = sorted(got, key=lambda r: r.start)
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in by_start]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert simple8b.round_trip(no_docs, path).count() == 0
