"""Quality rules whose thresholds follow each language and source.

Every document gets counts as integers. Their distribution in each language and source is kept as a mergeable
quantile sketch: a histogram over values cut to their six leading bits, so a quantile is right to 1/32 of its value
at least, and sketches of parts add up to the sketch of the whole. Groups with too few documents use the merged
sketch of their language, then of everything. The thresholds are joined back to the documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, staged

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: measure: (documents are rejected above the upper fence, below the lower one, scale of the rate, the count it is a rate of, words or signs of one event)
MEASURES = {
    "symbols": (True, False, 1000, "word_chars", 1),  # symbols per 1000 characters of words
    "dup_lines": (True, False, 1000, "n_lines", 1),  # repeated lines per 1000 lines
    "repeats": (True, False, 1000, "n_words", WINDOW),  # words in repeated windows per 1000 words
    "stutter": (True, False, 1000, "n_words", 1),  # words that repeat the word before them per 1000 words
    "upper": (True, False, 1000, "word_chars", 1),  # capital letters per 1000 characters of words
    "word_length": (True, True, 100, "n_words", 1),  # characters per 100 words
}
SIZES = ("n_words", "word_chars", "n_lines")  # sketched like the measures, for the unit of a rate
SPREAD = 8  # fences stand this many scales from the median
MIN_DOCS = 50  # documents that a group needs for a sketch of its own


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated(words: Column) -> Column:
    """struct(windows, neighbours): words that lie in a window of eight found twice or more, and words that equal the one before them.

    Words and windows are compared by 64-bit hashes.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s, x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
        starts = lambda s: F.transform(F.filter(s, lambda x, k: twice(s, x, k)), lambda x: x["i"])
        span = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        total = lambda p: F.aggregate(span(p), F.lit(0), lambda a, x: a + x)
        return once(pairs, lambda s: once(F.array_sort(starts(s)), total))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    found = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
    equal = lambda h: F.size(F.filter(h, lambda x, i: F.get(h, i - 1).eqNullSafe(x)))
    both = lambda h: F.struct(F.when(F.size(h) > WINDOW, once(windows(h), found)).otherwise(0).alias("windows"), equal(h).alias("neighbours"))
    return once(F.transform(words, lambda w: F.xxhash64(w)), both)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds one struct ``m`` with the base counts, base_failed, and the adaptive measures. A null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE + "+", "") != "")
    long = lambda c: c.cast("long")
    counts = F.struct(
        once(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeated(w).alias("r"))).alias("w"),
        once(lines, lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.length(F.regexp_replace(text, r"\P{Lu}+", ""))).alias("n_upper"),
    )

    def derive(m: Column) -> Column:
        n, chars, windows = m["w"]["n_words"], F.greatest(m["w"]["word_chars"], F.lit(1)), long(m["w"]["r"]["windows"])
        whole = lambda a, b, k=1000: ((a * k - (a * k) % b) / b).cast("long")
        return F.struct(
            n.alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), m["l"]["n_lines"].alias("n_lines"), windows.alias("n_repeat_words"),
            ((n < 20) | (100 * windows > 30 * n)).alias("base_failed"),
            whole(m["n_symbols"], chars).alias("symbols"), whole(m["l"]["n_dup_lines"], F.greatest(m["l"]["n_lines"], F.lit(1))).alias("dup_lines"),
            whole(windows, F.greatest(n, F.lit(1))).alias("repeats"), whole(long(m["w"]["r"]["neighbours"]), F.greatest(n, F.lit(1))).alias("stutter"), whole(m["n_upper"], chars).alias("upper"), whole(m["w"]["word_chars"], F.greatest(n, F.lit(1)), 100).alias("word_length"),
        )

    return docs.withColumn("m", once(counts, derive))


def sketch(rows: DataFrame, keys: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """Mergeable sketch of each language and source: (lang, source, measure, value, n), values cut to six leading bits.

    Grouped with partial sums, so a source that holds most documents shuffles no more rows than any other.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m.{k}").alias("value")) for k in keys]))
    rows = rows.select("lang", "source", entries.alias("e")).select("lang", "source", "e.measure", "e.value")
    cut = "greatest(length(bin(value)) - 6, 0)"
    return rows.groupBy("lang", "source", "measure", F.expr(f"shiftleft(shiftright(value, {cut}), {cut})").alias("value")).agg(F.count("*").alias("n"))


def fences(parts: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """Thresholds of each language and source from its sketch, or from the merged one of its language, or of all.

    Returns (lang, source) and low_<measure>, high_<measure>: median +- spread x scale. The scale is the wider of the two
    half-quartile ranges plus the unit of the measure, by which they are uncertain: what one event adds to the rate of the group's median
    document, from the sketch of the sizes, or the width of the sketch's bin at the median. So where three quarters of a group have none of something, a document may have
    ``spread`` events in a median document's length. Rejects do not move their thresholds until they are a quarter of a group.
    """
    groups = [("lang", "source"), ("lang",), ()]
    levels = []
    for depth, keys in enumerate(groups):
        s = parts.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        s = s.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("docs", F.sum("n").over(w))
        at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * p, F.col("value")))
        q = s.groupBy(*keys, "measure").agg(F.max("docs").alias(f"docs{depth}"), at(25).alias("a"), at(50).alias("b"), at(75).alias("c"))
        levels.append(q.select(*keys, "measure", f"docs{depth}", F.struct("a", "b", "c").alias(f"q{depth}")))
    own, lang, top = levels
    lang = lang.withColumnRenamed("lang", "of_lang").withColumnRenamed("measure", "m1")
    top = top.withColumnRenamed("measure", "m2")
    t = own.join(lang, own.lang.eqNullSafe(lang.of_lang) & (own.measure == lang.m1), "left").join(top, F.col("measure") == F.col("m2"), "left")
    q = F.when(F.col("docs0") >= min_docs, F.col("q0")).when(F.col("docs1") >= min_docs, F.col("q1")).otherwise(F.col("q2"))
    t = t.select("lang", "source", "measure", q.alias("q"))
    value = lambda k, x: F.max(F.when(F.col("measure") == k, F.col(f"q.{x}"))).alias(f"{x}_{k}")
    t = t.groupBy("lang", "source").agg(*[value(k, x) for k in MEASURES for x in "abc"], *[value(k, "b") for k in SIZES])
    limits = []
    for k, (up, down, rate, size, event) in MEASURES.items():
        a, b, c, per = F.col(f"a_{k}"), F.col(f"b_{k}"), F.col(f"c_{k}"), F.greatest(F.col(f"b_{size}"), F.lit(1))
        width = F.expr(f"shiftleft(1L, greatest(length(bin(b_{k})) - 6, 0))")
        reach = spread * (F.greatest(b - a, c - b) + F.greatest(F.ceil(F.lit(rate * event) / per), width))
        limits += [(b + reach).alias(f"high_{k}")] * up + [(b - reach).alias(f"low_{k}")] * down
    return t.select("lang", "source", *limits)


def judged(rows: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """Stores the measured rows once, sketches them, and joins the thresholds back: adds ``kept``.

    The threshold table has one row per language and source, and no hint: adaptive execution broadcasts it by its
    measured size or else splits the skewed sources of the join.
    """
    rows = staged(rows)
    limits = fences(sketch(rows, (*MEASURES, *SIZES)), min_docs, spread)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(c) for c in limits.columns[2:]])
    joined = rows.join(limits, rows.lang.eqNullSafe(limits._lang) & rows.source.eqNullSafe(limits._source), "left")
    within = ~F.col("m.base_failed")
    for k, (up, down, *_) in MEASURES.items():
        within = within & (F.col(f"m.{k}") <= F.col(f"high_{k}")) if up else within
        within = within & (F.col(f"m.{k}") >= F.col(f"low_{k}")) if down else within
    return joined.withColumn("kept", within).drop("_lang", "_source", *limits.columns[2:])


def report(docs: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """doc_id, the base counts, base_failed, the measures and ``kept`` of every document.

    Null language or source is a group of its own. Repeated rows are judged each. An empty table gives none.
    """
    rows = measured(columns_of(docs, doc_id="doc_id", text="text", lang="lang", source="source")).select("doc_id", "lang", "source", "m")
    return judged(rows, min_docs, spread).select("doc_id", *[f"m.{c}" for c in STATS], "m.base_failed", "kept", *[f"m.{k}" for k in MEASURES])


def keep(docs: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "lang", "source")
    return judged(measured(rows).drop("text"), min_docs, spread).where("kept").select("_doc.*")
