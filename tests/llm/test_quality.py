import re
from collections import Counter

from marketloom.llm import quality


def counts(text):
    """Base counts by plain loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def test_base_counts(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.report(odd_docs).collect())
    assert got == sorted((r.doc_id or -1, *counts(r.text)) for r in odd_docs.collect())
    assert quality.report(no_docs).count() == 0 and quality.keep(no_docs).columns == no_docs.columns


def test_windows_at_the_edges(spark):
    a, b = "a b c d e f g h".split(), "p q r s t u v w".split()
    texts = [a, a + a, a + b + a, a + b, a + a[:7], b + a + a + b, ["x"] * 9, ["x"] * 8, ["x"] * 40, a[:7] + a[:7]]
    df = spark.createDataFrame([(i, " ".join(t), "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.report(df).collect()}
    assert got == {i: counts(" ".join(t))[4] for i, t in enumerate(texts)}


def test_thresholds_follow_the_group(spark):
    clean = " ".join(f"word{i}x" for i in range(60)) + "."
    noisy = " ".join(f"wo{i}|#" for i in range(60))
    rows = [(i, clean, "en", "prose") for i in range(200)] + [(1000 + i, noisy, "en", "prose") for i in range(20)] + [(2000 + i, noisy, "en", "tables") for i in range(200)]
    rows += [(3000, noisy, "en", "rare"), (3001, clean, "en", "rare"), (3002, clean, None, None), (3003, None, None, "prose")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep(df).collect()}
    assert set(range(200)) <= kept and not kept & set(range(1000, 1020))  # noise among prose goes
    assert set(range(2000, 2200)) <= kept  # where symbols are usual they stay
    assert 3001 in kept and 3002 in kept and 3003 not in kept


def test_sketches_merge_and_are_close(spark):
    df = spark.range(5000).selectExpr("'en' as lang", "cast(id % 3 as string) as source", f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, id * id' for k in quality.MEASURES)}) as m")
    whole = {(r.source, r.value): r.n for r in quality.sketch(df).where("measure = 'upper'").collect()}
    parts = Counter()
    for half in (df.where("m.upper % 2 = 0"), df.where("m.upper % 2 = 1")):
        for r in quality.sketch(half).where("measure = 'upper'").collect():
            parts[r.source, r.value] += r.n
    assert whole == dict(parts)
    assert all(v <= x < v + max(1, v // 32) for x in (i * i for i in range(5000)) for v in [x >> max(0, x.bit_length() - 6) << max(0, x.bit_length() - 6)] if (str(round(x**0.5) % 3), v) in whole)
    assert len({v for _, v in whole}) < 32 * 25


def test_no_python(spark, odd_docs):
    assert "Python" not in quality.report(odd_docs)._jdf.queryExecution().executedPlan().toString()


def test_unit_follows_the_size_of_a_group(spark):
    """Where nearly no document has an odd thing, the fence is SPREAD events in the group's median document, in whole parts of a thousand, not a fixed rate."""
    text = lambda n, odd: " ".join(f"w{i % 7}o{i}" + ("#" if i < odd else "") for i in range(n))
    rows = [(i, text(40, 0), "en", "short") for i in range(100)] + [(1000 + i, text(800, 0), "en", "long") for i in range(100)]
    rows += [(2000, text(40, 6), "en", "short"), (2001, text(40, 12), "en", "short"), (2002, text(800, 6), "en", "long"), (2003, text(800, 60), "en", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in quality.report(df).where("not kept").collect()}
    assert gone == {2001, 2003}
