"""Audit of text filters in every order of application, with exact duplicates found by radix tries.

A filter fails or passes a document whatever came before it, so one bit mask for each document holds all that any order
needs. Four filters look at the text alone. The fifth, the exact duplicate of a smaller id, needs the whole table:

1. Each task puts its texts into compressed radix tries of whole texts, whose terminals hold the smallest id. A larger id with the
   same text is a duplicate at once and gives up its text, so a group of copies sends one text from each task, however large it is.
2. What is left goes to ranges of texts named by prefixes. A prefix that covers too many bytes of different texts is replaced by longer
   ones, until each range fits a task's memory; texts that are equal need one place in a trie, so copies never make a range large.
3. Each range is one trie: whole texts are inserted, the smallest id stays at the terminal, and traversing it gives the originals.

Masks are then reduced to counts for each part, and only those 32 counts meet the orders.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, parallelism, prepare, staged

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MARKS = re.compile(rb"[#$%&*|]")
LOWER = bytes(b for b in range(256) if not 65 <= b <= 90)
WINDOW_BYTES = 16 << 20  # of different texts in a task's trie before it is written out
RANGE_BYTES = 32 << 20  # of different texts below a prefix before it is split, at most
RANGES = 4  # a prefix is also split when it covers more than a partition's share of all bytes divided by this
NODE_BYTES = 300  # a node's own memory, about
FIRST = 8  # characters of the shortest prefixes; longer ones double


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    words = text.split()  # of bytes: the white space of ASCII
    n = len(words)
    few, same = n < 200, 100 * len(set(words)) < 50 * n
    capitals = len(text.translate(None, LOWER))
    return few | same << 1 | (100 * capitals > 3 * n_chars) << 2 | bool(MARKS.search(text)) << 3


def common(a: bytes, b: bytes, at: int) -> int:
    """Bytes that ``a`` shares with ``b`` from ``at`` on, by halving, so that memory comparison does the work."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over whole texts: a node is [label, {first byte: child}, terminal or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.size = 0

    def place(self, text: bytes) -> list:
        """The node at which the text ends, made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = child = [text[at:], {}, None]
                self.size += len(text) - at + NODE_BYTES
                return child
            label = child[0]
            k = common(label, text, at)
            if k < len(label):  # the edge is cut where the texts part
                upper = [label[:k], {label[k]: child}, None]
                child[0] = label[k:]
                node[1][text[at]] = child = upper
            node, at = child, at + k
        return node

    def terminals(self) -> Iterator[list]:
        """All nodes that end a text."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node
            stack.extend(node[1].values())


#: Rows between the stages. ``copies`` counts repeated rows with one id, text and part.
ROW = pa.schema([("range", pa.string()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("copies", pa.int64()), ("original", pa.bool_())])
DDL = "range string, text binary, doc_id long, part string, mask int, copies long, original boolean"


def first_of(held: list | None, doc_id: int, part: str, mask: int, copies: int) -> tuple[list, list[tuple]]:
    """(terminal, rows that turned out to be duplicates). A terminal is [smallest id, mask, {part: rows with that id}, written]."""
    if held is None:
        return [doc_id, mask, {part: copies}, False], []
    if doc_id > held[0]:
        return held, [(doc_id, part, mask | DUPLICATE, copies)]
    if doc_id == held[0]:
        held[2][part] = held[2].get(part, 0) + copies
        return held, []
    lost = [] if held[3] else [(held[0], p, mask | DUPLICATE, n) for p, n in held[2].items()]
    return [doc_id, mask, {part: copies}, False], lost


class Rows:
    """Collects rows and hands them on in batches of a few megabytes."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += 100 + len(row[1] or b"")

    def full(self) -> bool:
        return self.bytes > 4 << 20

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), ROW)] if self.rows else [pa.array([], f.type) for f in ROW], schema=ROW)
        self.rows, self.bytes = [], 0
        return out


def range_of(text: str, split: set[str], deepest: int) -> str:
    """The shortest prefix of the text that is not split."""
    size = FIRST
    while size <= deepest and text[:size] in split:
        size *= 2
    return text[:size]


def heavy_prefixes(texts: DataFrame, limit: int) -> list[str]:
    """Prefixes with more bytes of different texts below them than ``limit`` or a quarter of an even share of the partitions.

    A round for each length, doubling, over the texts below the last round's heavy prefixes, while there are any. Copies
    are combined on the map side by a 64-bit hash, for sizes only. At most all bytes / limit prefixes a round reach the driver,
    or four for each partition. Where they lie changes which task sees a text, not the result.
    """
    total = texts.agg(F.sum(F.octet_length("text") + NODE_BYTES)).first()[0] or 0
    limit = min(limit, max(NODE_BYTES, total // (RANGES * parallelism(texts.sparkSession))))
    out: list[str] = []
    rows, size = texts, FIRST
    while True:
        sizes = rows.groupBy(F.substring("text", 1, size).alias("prefix"), F.xxhash64("text").alias("h")).agg(
            F.first(F.octet_length("text") + NODE_BYTES).alias("bytes"))
        heavy = sizes.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("texts"))
        found = [r.prefix for r in heavy.where((F.col("bytes") > limit) & (F.col("texts") > 1)).select("prefix").collect()]
        out += found
        if not found:
            return out
        rows = rows.where(F.substring("text", 1, size).isin(found))
        size *= 2


def masked(docs: DataFrame, check: Callable[[bytes, int], int] = text_mask, window_bytes: int = WINDOW_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part, mask, copies: the filters that each document fails, ``copies`` repeated rows in one.

    ``docs`` has doc_id, text, part. A null text is empty. A text equal to that of a smaller id fails E; rows that
    share their smallest id are no copies of each other, and a null id is neither smaller nor larger than any, so such a
    row fails E never and makes no other one fail. An empty table gives none.
    """
    rows = columns_of(docs, doc_id="doc_id", text="text", part="part").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), "part")
    split = set(heavy_prefixes(rows.select("text"), range_bytes))
    deepest = max(map(len, split), default=0)

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, spread = Trie(), Rows(), 0
        nobody: dict[tuple[str, int], int] = {}  # rows without an id, by part and mask

        def done(rows: list[tuple]) -> None:
            nonlocal spread
            for doc_id, part, mask, copies in rows:
                spread += 1
                out.add((f"\0{spread % 1024}", None, doc_id, part, mask, copies, False))

        def write_out() -> Iterator[pa.RecordBatch]:
            """Writes what is new; texts that came more than once stay, so that they are not written again."""
            nonlocal trie
            again = Trie()
            for node in trie.terminals():
                text, held, many = node[2]
                if not held[3]:
                    key = range_of(text.decode(), split, deepest)
                    for part, copies in held[2].items():
                        out.add((key, text, held[0], part, held[1], copies, True))
                    held[3] = True
                if many and again.size < window_bytes // 2:
                    again.place(text)[2] = [text, held, True]
                if out.full():
                    yield out.batch()
            trie = again

        for b in it:
            texts, ids, parts = (b.column(i).to_pylist() for i in range(3))
            for s, doc_id, part in zip(texts, ids, parts):
                text = s.encode()
                if doc_id is None:
                    key = part, check(text, len(s))
                    nobody[key] = nobody.get(key, 0) + 1
                    continue
                node = trie.place(text)
                if node[2] is None:
                    node[2] = [text, first_of(None, doc_id, part, check(text, len(s)), 1)[0], False]
                else:
                    held = node[2][1]
                    if doc_id == held[0] and held[3]:
                        held[2], held[3] = {}, False  # the rows before are written; this one follows
                    node[2][1], lost = first_of(held, doc_id, part, held[1], 1)
                    node[2][2] = True
                    done(lost)
            if trie.size > window_bytes:
                yield from write_out()
            if out.full():
                yield out.batch()
        yield from write_out()
        done([(None, *key, copies) for key, copies in nobody.items()])
        yield out.batch()

    def final(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, at = Trie(), Rows(), None

        def write_out() -> Iterator[pa.RecordBatch]:
            for node in trie.terminals():
                doc_id, mask, parts, _ = node[2]
                for part, copies in parts.items():
                    out.add((None, None, doc_id, part, mask, copies, None))
                if out.full():
                    yield out.batch()

        for b in it:
            for key, text, doc_id, part, mask, copies, original in zip(*(c.to_pylist() for c in b.columns)):
                if not original:
                    out.add((None, None, doc_id, part, mask, copies, None))
                    continue
                if key != at:
                    yield from write_out()
                    trie, at = Trie(), key
                node = trie.place(text)
                node[2], lost = first_of(node[2], doc_id, part, mask, copies)
                for row in lost:
                    out.add((None, None, *row, None))
            if out.full():
                yield out.batch()
        yield from write_out()
        yield out.batch()

    sent = rows.mapInArrow(local, DDL).repartition("range").sortWithinPartitions("range")
    return sent.mapInArrow(final, DDL).select("doc_id", "part", "mask", "copies")


def orders(filters: str = FILTERS) -> Column:
    """Array of every (filter_order, step, filter, bit of the filter, bits of the filters before it)."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = []
    for order in map("".join, itertools.permutations(filters)):
        for k, f in enumerate(order):
            rows.append(f"struct('{order}' as filter_order, {k + 1} as step, '{f}' as letter, {bit[f]} as own, {sum(bit[x] for x in order[:k])} as before)")
    return F.expr(f"array({', '.join(rows)})")


def audit(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Effects of each filter at each step of each order, by part: one row, zeros included, for part x order x step.

    ``masks`` comes from ``masked``; ``labels`` has doc_id, quality, toxic. Labels of one id are combined (good or toxic
    if any row says so); documents without labels, and null labels, are neither. Masks are reduced to counts before they meet the
    orders, so the join with them has 32 rows a part at most. An empty table has no parts.
    """
    marks = columns_of(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = F.col("copies")
    counts = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(F.coalesce(F.col("good"), F.lit(0)) * n).alias("good"), F.sum(F.coalesce(F.col("toxic"), F.lit(0)) * n).alias("bad"))
    # 32 x 600 rows a part; partial sums leave one row a part, order and step.
    steps = staged(counts).select("part", "mask", "n", "good", "bad", F.explode(orders(filters)).alias("o")).select("part", "mask", "n", "good", "bad", "o.*")
    fails, gone, left = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.expr("own + before")) == 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    table = staged(steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(left).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "bad").alias("toxic_lost")))
    shapley = table.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return table.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``documents`` by language; a null language is the empty string."""
    prepare(docs.sparkSession)
    rows = columns_of(docs, doc_id="doc_id", text="text", part="lang").withColumn("part", F.coalesce("part", F.lit("")))
    return audit(masked(rows), labels)
