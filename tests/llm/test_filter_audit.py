"""The filter audit against counting every order document by document."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.llm import filter_audit as A


def brute(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)}"""
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            t = text or ""
            smallest[t] = min(smallest.get(t, doc_id), doc_id)
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > smallest[t]}
        good, toxic = labels.get(doc_id, (0, 0))
        rows.append((lang or "", fails, good == 1, toxic == 1))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in alive if r[1][f]]
                again = sum(r[1][f] for r in gone)
                alive = [r for r in alive if not r[1][f]]
                gone += lost
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                out[part, order, step] = [len(alive), len(lost), again, alone, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                total[part, f] = total.get((part, f), 0) + len(lost)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in A.report(docs, labels).collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0), "x") for k in range(400)] + [(None, 1, 1, "x"), (5, None, 1, "x")], "doc_id long, quality int, toxic int, part string")


def as_dict(labels):
    out = {}
    for doc_id, good, toxic, _ in labels.collect():
        if doc_id is not None:
            g, t = out.get(doc_id, (0, 0))
            out[doc_id] = (max(g, int(good == 1)), max(t, int(toxic == 1)))
    return out


def test_audit_by_brute_force(spark, labels):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "Blue", "a$b", "é", "green", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([0, 3, 150, 230, 400]))) for _ in range(60)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None])) for k in rng.sample(range(400), 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    want = brute(docs, as_dict(labels))
    got = audited(df, labels)
    assert len(got) == 3 * 600 and got == want


def test_odd_rows(odd_docs, no_docs, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    assert audited(odd_docs, labels) == brute(rows, as_dict(labels))
    assert A.report(no_docs, labels).count() == 0


def test_small_windows_and_ranges_give_the_same(spark):
    """Texts with long common prefixes, copies in every partition, and limits of a few hundred bytes."""
    rng = random.Random(4)
    head = "shared words " * 30
    texts = [head + "x" * rng.randint(0, 40) + str(rng.randint(0, 30)) for _ in range(80)] + [head, head[:-1], "", "short", "shor"]
    docs = [(k, rng.choice(texts) if k % 3 else texts[0]) for k in rng.sample(range(2000), 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("part", F.lit("p"))
    split = A.heavy_prefixes(df.select("text"), 2000)
    assert any(len(p) == 256 for p in split)
    got = {r.doc_id: bool(r["mask"] & A.DUPLICATE) for r in A.masked(df, window_bytes=1500, range_bytes=2000).collect()}
    smallest = {t: min(k for k, u in docs if u == t) for _, t in docs}
    assert got == {k: k > smallest[t] for k, t in docs}


def test_trie_keeps_every_text():
    rng = random.Random(6)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)}
    trie = A.Trie()
    for t in texts:
        node = trie.place(t)
        assert node[2] is None
        node[2] = t
    assert all(trie.place(t)[2] == t for t in texts)
    assert sorted(n[2] for n in trie.terminals()) == sorted(texts)
