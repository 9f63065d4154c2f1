import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from marketloom.llm import simhash
from marketloom.llm.components import components


def fingerprint(text, width=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_groups_by_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    base = docs[3].text
    extra = [(10**6 + i, base.replace(" ", "  ", i)) for i in range(3)] + [(10**6 + 10 + i, base + f" w{i}") for i in range(5)] + [(10**7, None), (10**7 + 1, " \n")]
    rows = [(r.doc_id, r.text) for r in docs] + extra
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {d: fingerprint(t) for d, t in rows}
    root = roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in prints.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", least[root[f]]) for d, f in prints.items())
    assert simhash.groups(odd_docs).count() == odd_docs.count() and simhash.groups(no_docs).count() == 0


@pytest.mark.parametrize("tile", [1 << 16, 8])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    base, prints = rng.getrandbits(64), set()
    x = base
    for _ in range(100):
        x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {base ^ (1 << i) for i in range(64)} | {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 2**64 - 4}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in prints], "f0 long")
    found = simhash.links(df, simhash.part_key(), simhash.part_neighbours(2), 2)
    links = found.collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in links)
    ids = sorted(map(signed, prints))
    want = roots(ids, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    got = {r.node: r.root for r in components(found).collect()}
    assert {n: got.get(n, n) for n in ids} == want
    assert len(links) < 5 * len(ids)  # forests, not all pairs


def test_components_of_paths_stars_and_repeats(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(path + star + path[:5] + [(5, 5), (7000, 6000)], "u long, v long").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1300), 1000), 6000: 6000, 7000: 6000}
    assert components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(30):
        base = words(rng.choice([12, 80, 300, 900]))
        ids = [100 * g + i for i in range(4)]
        near = base.copy()
        near[len(near) // 2] = "changed"
        texts = [base, base, near if len(base) > 60 else base, words(len(base))]
        rows += [(i, " ".join(t)) for i, t in zip(ids, texts)]
        groups += [ids[0], ids[3]]
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted(groups)
    out = simhash.keep_one(odd_docs)
    assert out.columns == odd_docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "7", "8", "9", "None"]
    assert simhash.keep_one(no_docs).count() == 0


def test_similarity_by_brute_force(spark):
    """Links are all pairs whose equal bits and sizes reach the similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.fingerprints(docs, 5, 4, distinct=True).collect()
    bits = {r.doc_id: np.array([r.f0, r.f1, r.f2, r.f3]).view(np.uint64) for r in rows}
    size = {r.doc_id: r.size for r in rows}
    near = lambda a, b: int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= 51 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])
    want = {r for r in roots(sorted(bits), near).values()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


@pytest.mark.parametrize("held", [1 << 19, 500])
def test_similarity_by_brute_force_jaccard(spark, monkeypatch, held):
    """One of each group stays whose sets of five-word shingles are connected by a Jaccard similarity of 0.8 or more."""
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for g in range(120):
        base = words(rng.choice([8, 20, 60, 104, 404]))
        texts[10 * g] = base
        for k, least in enumerate([0.66, 0.72, 0.78, 0.8, 0.84], 1):
            kept = round(2 * least / (1 + least) * len(base))
            texts[10 * g + k] = base[:kept] + words(len(base) - kept) if k % 2 else base[:kept]
    texts |= {5000: ["a"] * 6, 5001: ["a"] * 9, 5002: ["a"] * 5, 5003: ["b"] * 9}
    sets = {i: {tuple(w[at : at + 5]) for at in range(max(1, len(w) - 4))} for i, w in texts.items()}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(set(roots(sorted(sets), near).values()))


def test_radius_keeps_similar_sets():
    """Pairs of a Jaccard similarity of exactly 0.8 are candidates, small ones too."""
    rng = np.random.default_rng(3)
    for small, large in [(4, 5), (8, 10), (12, 15), (90, 90), (400, 400)]:
        same = small if small < large else small * 8 // 9
        for _ in range(300):
            h = rng.integers(0, 256, (large + small - same, 32), np.uint8)
            a, b = simhash.majority(h[:small]), simhash.majority(np.concatenate([h[:same], h[small:]]))
            far = np.bitwise_count(a ^ b).astype(int)
            assert far.sum() <= simhash.set_radius(0.8, 256) and far[:16].sum() <= simhash.set_radius(0.8, 128)
