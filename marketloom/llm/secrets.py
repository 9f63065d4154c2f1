"""Secrets in texts: named assignments, access keys, hex strings, and strings that pass a battery of randomness tests.

Candidates of the battery are runs of encoding characters. The smallest alphabet that holds a candidate is its
inferred encoding. Against "uniform over that alphabet" stand three tests: chi-squared of the symbol counts, runs above and below
the middle of the alphabet, and lag-one serial correlation. A candidate that any of them rejects is not random. That alone would
let short words pass, so a second question is asked: how likely is as even a spread of symbols in ordinary text? Ordinary
text has the symbol frequencies of the whole corpus; the repeats among n symbols have a known mean and variance under them, which
gives a p-value that falls with the length. Benjamini and Hochberg's step-up rule over the candidates of each encoding and length
band keeps the expected share of ordinary strings among the reports below the rate; short bands need smaller values,
which short strings rarely reach.

One pass over the texts gives base spans, candidates with their statistics, and the symbol counts of each batch. It is stored
without the strings. A histogram of p-values for each encoding and band gives its limit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, staged

# Fixed patterns and lengths of the base rules. Upper-case letters were made lower-case for the first one.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

SHORTEST = 16  # symbols of a candidate
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest; plain digits are ids and numbers, plain letters words.
ENCODINGS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
PLAIN = [frozenset(DIGITS.encode()), frozenset((LOWER + UPPER).encode())]
SETS = {name: frozenset(a.encode()) for name, a in ENCODINGS.items()}
#: Place of each byte in an encoding's alphabet.
CODE = {name: np.array([a.encode().find(bytes([b])) for b in range(256)]) for name, a in ENCODINGS.items()}
BANDS = [16, 24, 32, 48, 64, 96, 128]  # shortest length of each band
REJECT = 0.001  # a candidate is not random when a test's p-value, times the tests, is below
RATE = 0.01  # expected share of ordinary strings among the reports of a band
STEP = 20  # bins of a p-value's decimal logarithm in one unit
LOWEST = -30.0


def tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def encoding_of(token: bytes) -> str | None:
    """The smallest encoding that holds the token; None for plain digits or letters, and for none."""
    have = frozenset(token)
    if any(have <= p for p in PLAIN):
        return None
    return next((name for name, a in SETS.items() if have <= a), None)


def battery(token: bytes, encoding: str) -> tuple[int, float]:
    """(repeats, smallest p-value times three) of the tests against uniform symbols of the encoding.

    ``repeats`` is the sum of c (c - 1) over the symbols' counts c; chi-squared is a linear function of it.
    """
    x = CODE[encoding][np.frombuffer(token, np.uint8)]
    n, k = len(x), len(ENCODINGS[encoding])
    counts = np.bincount(x, minlength=k)
    repeats = int((counts * (counts - 1)).sum())
    chi = (repeats + n) * k / n - n
    p = [tail((chi - (k - 1)) / math.sqrt(2.0 * (k - 1) * (1.0 - 1.0 / n)))]  # few repeats are no evidence of order
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1.0 + 2.0 * a * b / n
        spread = 2.0 * a * b * (2.0 * a * b - n) / (n * n * (n - 1.0))
        turns = 1 + int((high[1:] != high[:-1]).sum())
        p.append(2.0 * tail(max(0.0, abs(turns - mean) - 0.5) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = x - x.mean()
    power = float((centred * centred).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p.append(2.0 * tail(abs(r + 1.0 / n) * math.sqrt(n)))
    return repeats, min(1.0, 3.0 * min(p))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()  # of bytes: A-Z alone
    if any(h in low for h in ASSIGN_HINTS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(low) if len(m[1]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: bytes, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, encoding, repeats) of the strings outside base spans that the battery does not reject."""
    k, last = 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][0] < end:  # by start, so one pass
            last = max(last, taken[k][1])
            k += 1
        if last > start or not (encoding := encoding_of(m[0])):
            continue
        repeats, p = battery(m[0], encoding)
        if p >= REJECT:
            yield start, end, encoding, repeats


class Points:
    """Places of bytes as places of code points, asked for in any order."""

    def __init__(self, text: bytes):
        self.plain = text.isascii()
        if not self.plain:
            self.before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])

    def at(self, byte: int) -> int:
        return byte if self.plain else int(self.before[byte])


def band(n: Column) -> Column:
    """Shortest length of the band."""
    return F.array_max(F.filter(F.array(*[F.lit(b) for b in BANDS]), lambda b: b <= n))


def natural(frequencies: DataFrame) -> DataFrame:
    """encoding, s2, s3: sums of squares and cubes of the corpus's symbol frequencies within each alphabet."""
    pairs = [(name, b) for name, a in ENCODINGS.items() for b in a.encode()]
    known = F.expr("array(" + ",".join(f"struct('{n}' as encoding, {b} as byte)" for n, b in pairs) + ")")
    q = frequencies.groupBy("byte").agg(F.sum("n").alias("n"))
    q = q.join(q.sparkSession.range(1).select(F.explode(known).alias("k")).select("k.*"), "byte")
    q = q.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("encoding")))
    return q.groupBy("encoding").agg(F.sum(F.pow("q", F.lit(2))).alias("s2"), F.sum(F.pow("q", F.lit(3))).alias("s3"))


def log_tail(z: Column) -> Column:
    """Decimal logarithm of the lower tail of the normal distribution: a rational bound below z = 0, within a few per cent."""
    x = F.abs(z)
    upper = F.exp(-x * x / 2) * F.sqrt(F.lit(2.0) / F.lit(math.pi)) / (x + F.sqrt(x * x + F.lit(8.0 / math.pi)))  # at least the tail, equal at 0
    return F.log10(F.when(z < 0, upper).otherwise(1.0 - upper))


def chosen(key: Column, values: dict[str, float]) -> Column:
    """The value of a key among a few; null for others."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key] if values else F.lit(None).cast("double")


def evenness(n: Column, repeats: Column, s2: Column, s3: Column) -> Column:
    """Binned decimal logarithm of the probability of so few repeats in ordinary text; bins round up, which can only lose reports."""
    n = n.cast("double")
    pairs = n * (n - 1)
    mean = pairs * s2
    spread = 2 * pairs * (s2 - s2 * s2) + 4 * pairs * (n - 2) * F.greatest(s3 - s2 * s2, F.lit(0.0))
    shape = mean * mean / spread  # the repeats are close to a gamma variable, whose cube root is close to a normal one
    z = F.when(spread > 0, (F.cbrt((repeats + 1) / mean) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape)).otherwise(0.0)
    return F.greatest(F.ceil(log_tail(z) * STEP) / STEP, F.lit(LOWEST))


def limits(binned: DataFrame, rate: float) -> dict[str, float]:
    """{encoding:band: largest bin to report} by the step-up rule, from a histogram of (encoding, band, bin).

    At most one value for each encoding and band reaches the driver.
    """
    counts = binned.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("here"))
    w = Window.partitionBy("encoding", "band")
    counts = counts.withColumns({"upto": F.sum("here").over(w.orderBy("bin")), "all": F.sum("here").over(w)})
    passes = F.pow(F.lit(10.0), F.col("bin")) * F.col("all") <= rate * F.col("upto")
    rows = counts.groupBy("encoding", "band").agg(F.max(F.when(passes, F.col("bin"))).alias("bin")).where("bin is not null").collect()
    return {f"{r.encoding}:{r.band}": r.bin for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Spans of every text: doc_id, base, random, each an array of (start, end, kind) in code points, end exclusive.

    ``kind`` numbers KINDS; ``base`` is by start, then kind, ``random`` by start. A null or empty text has none. Repeated
    rows and null ids are kept, each with its own result, and repeated candidates count each in the rates. An empty table
    gives none. Other columns are not read.
    """
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
    try_ = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int64()), ("repeats", pa.int64())])
    count = pa.struct([("byte", pa.int32()), ("n", pa.int64())])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans, tries, seen = [], [], np.zeros(256, np.int64)
            for text in b.column(1).to_pylist():
                text = text or b""
                base = base_spans(text)
                more = list(candidates(text, base))
                at = Points(text).at if base or more else None
                spans.append([{"start": at(s), "end": at(e), "kind": k} for s, e, k in base])
                tries.append([{"start": at(s), "end": at(e), "encoding": c, "n": e - s, "repeats": r} for s, e, c, r in more])
                seen += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            # The batch's symbol counts ride on its first row.
            counts = [[{"byte": i, "n": int(seen[i])} for i in np.flatnonzero(seen)]] + [None] * (b.num_rows - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(tries, pa.list_(try_)), pa.array(counts[: b.num_rows], pa.list_(count))],
                                             ["doc_id", "base", "tries", "counts"])

    ddl = (f"doc_id {dict(docs.dtypes)[id_col]}, base array<struct<start:bigint,end:bigint,kind:int>>, "
           "tries array<struct<start:bigint,end:bigint,encoding:string,n:bigint,repeats:bigint>>, counts array<struct<byte:int,n:bigint>>")
    stored = staged(rows.mapInArrow(work, ddl))
    sums = natural(stored.where("counts is not null").select(F.explode("counts").alias("c")).select("c.*")).collect()  # one row an encoding
    s2, s3 = {r.encoding: r.s2 for r in sums}, {r.encoding: r.s3 for r in sums}
    even = lambda t: evenness(t["n"], t["repeats"], chosen(t["encoding"], s2), chosen(t["encoding"], s3))
    tries = stored.select(F.explode("tries").alias("t"))
    most = limits(tries.select("t.encoding", band(F.col("t.n")).alias("band"), even(F.col("t")).alias("bin")), rate)
    reported = lambda t: even(t) <= chosen(F.concat_ws(":", t["encoding"], band(t["n"]).cast("string")), most)
    shown = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(KINDS.index("random")).alias("kind"))
    return stored.select("doc_id", "base", F.transform(F.filter("tries", reported), shown).alias("random"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans in order as a string."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])
    every = F.when(F.size("random") > 0, F.array_sort(F.concat("base", "random"), order)).otherwise(F.col("base"))
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))
