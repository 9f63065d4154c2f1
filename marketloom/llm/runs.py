"""Periodic runs of words by maximal pairs over the LCP-interval tree of each text.

A maximal pair is two places i < j with l equal words from each on, whose left words differ and whose right words differ.
If their distance q = j - i is at most l / 2, the stretch from i to j + l has period q, holds it three times at least, and
no neighbouring word extends it: maximal pairs that meet the length constraints are exactly the runs, so nothing is
extended. Several pairs can name one stretch (distances q, 2q ...); the least distance is its smallest period.

Words become numbers, blocks of 1, 2, 4, 8, 16 words are ranked with numpy for a whole Arrow batch, and texts
in which no block of sixteen repeats have no such pair. For the others the suffix array comes from ranks of doubled
blocks, common prefixes from the same ranks, and the intervals of the tree are closed bottom-up. A closed interval holds its places
in order, each in the class of its left word; of two joined lists the shorter one asks the longer one for its
neighbours. Only neighbours of another class count: between two occurrences that are a smallest period apart lies no third one.

Every text is worked on whole and alone, so nothing is shuffled. Memory is that of one Arrow batch, or of one
text if that is longer.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

SPACE = r"[\x20\x09-\x0D]"
LEAST = 24  # words of a run at least
TIMES = 3  # periods in a run at least
CHUNK = 400_000  # words whose suffixes are sorted together
FIELDS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, in its own text's range of numbers; first place of each text and the end)."""
    flat, ends, base = [], [0], 0
    for words in texts:
        known: dict[bytes, int] = {}
        flat.extend([base + known.setdefault(w, len(known)) for w in words])
        base += len(known)
        ends.append(len(flat))
    return np.array(flat, np.int64), np.array(ends, np.int64)


def repetitive(ids: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Texts in which some block of words occurs twice; ``block`` is a power of two."""
    if not len(ids):
        return np.empty(0, np.int64)
    rank = ids
    keep = np.bincount(ids)[ids] > 1
    size = 1
    while size < block:
        at = np.flatnonzero(keep[:-size] & keep[size:]) if len(keep) > size else np.empty(0, np.int64)
        _, group, count = np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + size], return_inverse=True, return_counts=True)
        rank, keep = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        rank[at], keep[at] = group, count[group] > 1  # numbers of words differ between texts, so equal blocks are of one text
        size *= 2
    return np.unique(np.searchsorted(ends, np.flatnonzero(keep), side="right") - 1)


def suffixes(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of the joined texts, words that each suffix shares with the one before it)."""
    n = len(ids)
    last = np.repeat(ends[1:], np.diff(ends))
    levels, rank, size = [], np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        if int(rank.max()) + 1 == n:
            break
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + size < last)
        after[inside] = rank[inside + size] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        size *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 2, -1, -1):
        same = (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]) & (a < n) & (b < n)
        a, b = a + (same << k), b + (same << k)
        shared[1:] += same.astype(np.int64) << k
    return order, shared


def pairs(order: list[int], shared: list[int], left: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} from one part of the suffix array, all of whose neighbours share words enough."""
    found: dict[tuple[int, int], int] = {}

    def meet(i: int, j: int, l: int) -> None:  # noqa: E741
        q = j - i
        if l >= (times - 1) * q and l + q >= least and left[i] != left[j]:
            key = (i, j + l)
            if q < found.get(key, q + 1):
                found[key] = q

    def join(a: list[int], b: list[int], l: int) -> list[int]:  # noqa: E741
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect(a, x)
            if k:
                meet(a[k - 1], x, l)
            if k < len(a):
                meet(x, a[k], l)
        if len(b) < 32:
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()  # two ordered stretches are merged
        return a

    stack: list[tuple[int, list[int]]] = []  # open intervals: words shared, places so far
    held = [order[0]]
    for x, l in zip(order[1:] + [-1], shared[1:] + [0]):  # noqa: E741
        while stack and stack[-1][0] > l:
            deep, before = stack.pop()
            held = join(before, held, deep)
        if x < 0:
            break
        if stack and stack[-1][0] == l:
            stack[-1] = (l, join(stack[-1][1], held, l))
        else:
            stack.append((l, held))
        held = [x]
    return found


def find(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, ends = numbered(texts)
    depth = max(1, -(-least * (times - 1) // times))  # words shared by any pair that counts
    block = 1 << (depth.bit_length() - 1)
    some = repetitive(ids, ends, block)
    part: list[int] = []
    for k, t in enumerate(some.tolist()):
        part.append(t)
        if k + 1 < len(some) and sum(len(texts[u]) for u in part) + len(texts[some[k + 1]]) <= CHUNK:
            continue
        joined = np.concatenate([ids[ends[u] : ends[u + 1]] for u in part])
        first = np.concatenate([[0], np.cumsum([len(texts[u]) for u in part])])
        order, shared = suffixes(joined, first)
        # The word before each place; the start of a text is a class of its own.
        left = np.concatenate([[-1], joined[:-1]])
        left[first[:-1]] = -1
        left = left.tolist()
        deep = shared >= depth
        starts = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]])) - 1
        stops = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]])) + 1
        for a, b in zip(starts.tolist(), stops.tolist()):
            for (i, end), q in pairs(order[a:b].tolist(), shared[a:b].tolist(), left, least, times).items():
                at = int(np.searchsorted(first, i, side="right")) - 1
                out[part[at]].append((i - int(first[at]), end - i, q))
        part = []
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those of a run after its first period are dropped."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs of every text and the text without their repeats: doc_id, n_words, runs, best, collapsed.

    ``runs`` is an array of (start, length, period) in words from 0, by start, then period; ``best`` the one with the
    greatest length / period, null where there is none; ``collapsed`` the kept words joined by one space. A null or empty
    text has no words, no runs and an empty collapsed text. Repeated rows and null ids are kept, each with its own
    result; equal exponents are ordered as ``strongest`` says. An empty table gives none. Other columns are not read.
    """
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [(t or b"").split() for t in b.column(1).to_pylist()]  # of bytes: the white space of ASCII
            runs = find(texts, least, times)
            structs = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            best = [r and dict(zip(("start", "length", "period"), r)) for r in map(strongest, runs)]
            kept = [b" ".join(kept_words(w, r)) for w, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(structs, pa.list_(FIELDS)), pa.array(best, FIELDS), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "runs", "best", "collapsed"])

    run = "struct<start:bigint,length:bigint,period:bigint>"
    out = rows.mapInArrow(work, f"doc_id {dict(docs.dtypes)[id_col]}, n_words bigint, runs array<{run}>, best {run}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_tails(docs: DataFrame) -> DataFrame:
    """Documents of which some get a periodic end: doc_id, text.

    With h the crc32 of the decimal id and g = h div 10, each word i >= a of a document with h % 10 = 0 becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8) for n words. Other documents, those without words and
    those without an id stay as they are.
    """
    words = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(w: Column) -> Column:
        g, n = F.expr(f"{H} div 10"), F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        moved = F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, place(i))), " ")
        return F.when(F.size(w) > 0, moved).otherwise("")

    rows = columns_of(docs, doc_id="doc_id", text="text").withColumn(H, h)
    changed = F.element_at(F.transform(F.array(words), tail), 1)
    return rows.select("doc_id", F.when((F.col(H) % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


H = "_crc"


def digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and SHA-256 digests of the runs and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    b = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
