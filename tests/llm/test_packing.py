import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import catalog, packing
from marketloom.llm.encoding import ChunkEncoder


def laid_out(counts, capacity):
    seq, placed = defaultdict(list), Counter()
    for n, lo, ranks, copies, first, offset in packing.plan(counts, capacity):
        for i in range(ranks):
            seq[first + i // copies].append((offset + i % copies * n, n))
        placed[n] += ranks
    assert placed == Counter({k: v for k, v in counts.items() if v})
    for items in seq.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return seq


def best_fit_decreasing(items, capacity):
    free = []
    for x in sorted(items, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(capacity - x)
    return len(free)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_places_are_gapless_and_few(items):
    seq = laid_out(Counter(items), 30)
    assert -(-sum(items) // 30) <= len(seq) <= best_fit_decreasing(items, 30) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(11, 30), max_size=12))
def test_large_items_are_matched_best(items):
    def least(rest):
        if not rest:
            return 0
        x, *rest = rest
        return min([1 + least(rest)] + [1 + least(rest[:i] + rest[i + 1 :]) for i, y in enumerate(rest) if x + y <= 30])

    seq = laid_out(Counter(items), 30)
    assert len(seq) == least(sorted(items, reverse=True)[:8] if len(items) > 8 else sorted(items, reverse=True)) or len(items) > 8
    assert all(len(v) <= 2 for v in seq.values())


def test_lengths_outside_the_capacity_are_refused():
    for n in (0, 31):
        with pytest.raises(ValueError):
            packing.plan({n: 1}, 30)


def test_documents(spark, odd_docs, no_docs):
    path = catalog.vocabulary("word_bpe_49k.json")
    tokenizer = ChunkEncoder(path).tokenizer
    got = packing.pack_documents(odd_docs, path, 64, keep_ids=True)
    rows = got.collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id or -1, i // 64, i, len(p := ids[i : i + 64]), zlib.crc32(p.tobytes())) for i in range(0, len(ids), 64)]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *[n for _, n in sorted(items)]])[:-1].tolist()
    assert all(r.n_tokens <= 64 and len(r.ids) == 4 * r.n_tokens for r in packing.sequences(got).collect())
    assert packing.pack_documents(no_docs, path).count() == 0


def test_a_length_that_all_pieces_share(spark):
    parts = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "if(id % 10 = 0, 20L, 32L) as length").repartition(7)
    rows = packing.pack(parts, 64).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 1000 and len(places) == 450 + 34
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000
