"""Periodic runs against a scan over every period."""

import hashlib
import random
import zlib

from marketloom.llm import runs as R


def brute(words, least=24, times=3):
    """Every stretch with words q apart equal, not to be extended; the smallest q of each stretch."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    if kind < 0.6:
        out = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 14))]
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 80)] + [rng.choice("abxyz")] * rng.randint(0, 2)
        return out
    if kind < 0.8:
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        return (unit * rng.randint(1, 6) + ["c"]) * rng.randint(1, 8)
    return ["a"] * rng.randint(0, 60)


def test_runs_by_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(600):
        docs = [[w.encode() for w in some_words(rng)] for _ in range(rng.randint(1, 4))]
        least, times = rng.choice([(24, 3), (6, 2), (1, 3), (8, 2), (30, 4)])
        want = [brute(d, least, times) for d in docs]
        seen += sum(map(len, want))
        assert R.find(docs, least, times) == want
    assert seen > 1000


def test_long_and_many_suffixes():
    assert R.find([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    lines = [w for k in range(2000) for w in [b"w%d" % i for i in range(17)] + [b"%d" % k]]  # one passage, own words on both sides
    assert R.find([lines]) == [[]]


def test_the_strongest_run_by_exact_ratio():
    assert R.strongest([(9, 30, 10), (5, 60, 20), (5, 30, 10)]) == (5, 30, 10)
    assert R.strongest([]) is None


def tailed(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = tailed(doc_id, text)
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    best = R.strongest(runs)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_by_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(2)
    made = [(100 + k, " ".join(some_words(rng) or ["x"])) for k in range(60)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in R.digest(R.detect(R.with_tails(docs))).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 10
    wide = R.digest(R.detect(R.with_tails(odd_docs)))
    assert wide.count() == odd_docs.count() and R.detect(no_docs).count() == 0
