"""Best-fit packing of documents into sequences, large items matched first.

Pieces of one length are interchangeable, so the packing is worked out on the number of pieces of each length: a table of
at most ``capacity`` rows, however many documents there are. Its result says which ranks of a length go to which
places; each piece then finds its own place by its rank. Ranks are counted in hash buckets, so a length that most
pieces share is spread.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, columns_of, parallelism, staged
from .encoding import encoder

PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode whole texts, append ``end_id``, cut only what is longer than ``capacity``: doc_id, piece, start, length, ids_crc32 (, ids)."""
    rows = columns_of(docs, doc_id=id_col, text=text_col)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    schema = pa.schema(PIECES + [("ids", pa.binary())] * keep_ids)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary)
        for doc_ids, texts in batches(it, "doc_id", "text"):
            out = []
            for doc_id, ids in zip(doc_ids, codes.each(texts)):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces: (length, first rank, ranks, copies in a sequence, first sequence, offset).

    Pieces above a third of the capacity go at most two to a sequence; matching the largest with the largest partner
    that fits gives the fewest sequences for them. The others, in descending length, go to the tightest gap that takes
    them. Equal sequences are handled as one group with a count.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    gaps: dict[int, list[tuple[int, tuple]]] = {}  # free tokens: [(sequences, ((length, copies), ...))]
    order: list[int] = []  # the gaps in use, ascending

    def put(free: int, many: int, content: tuple) -> None:
        if many:
            if free not in gaps:
                bisect.insort(order, free)
                gaps[free] = []
            gaps[free].append((many, content))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            put(capacity - n, left[n], ((n, 1),))
            large.pop()
            continue
        m = large[at]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        if pairs:
            put(capacity - n - m, pairs, ((n, 2),) if m == n else ((n, 1), (m, 1)))
        left[n] -= pairs
        left[m] -= pairs
        if m == n and left[n]:  # one is over; it takes the next smaller partner
            if at == 0:
                put(capacity - n, left[n], ((n, 1),))
                large.pop()
                continue
            m = large[at - 1]
            put(capacity - n - m, 1, ((n, 1), (m, 1)))
            left[n] -= 1
            left[m] -= 1
        large = [x for x in large if left[x]]

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                put(capacity, -(-todo // (capacity // n)), ())  # enough new sequences
                continue
            free = order[at]
            many, content = gaps[free].pop()
            if not gaps[free]:
                del gaps[free]
                order.pop(at)
            each = free // n
            full = min(many, todo // each)
            put(free - each * n, full, (*content, (n, each)))
            todo -= full * each
            many -= full
            if many and todo and todo < each:
                put(free - todo * n, 1, (*content, (n, todo)))
                todo, many = 0, many - 1
            put(free, many, content)

    places, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for free in order:
        for many, content in gaps[free]:
            offset = 0
            for n, copies in content:
                places.append((n, rank[n], many * copies, copies, sequence, offset))
                rank[n] += many * copies
                offset += n * copies
            sequence += many
    return places


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with a ``length``; other columns stay.

    The driver gets one count per length, at most ``capacity`` rows, and returns places whose number depends on the
    lengths alone. Repeated rows get places of their own. An empty table stays empty.
    """
    spark = parts.sparkSession
    names = parts.columns
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}
    places = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * parallelism(spark))).alias("_bucket")
    rows = parts.select("*", bucket)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("_rank", within).join(base, ["length", "_bucket"]).select(*names, (F.col("_rank") + F.col("_base") - 1).alias("_rank"))
    span = 1 << 40  # more than the pieces of one length
    key = places[:, 0] * span + places[:, 1]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            _, lo, _, copies, sequence, offset = places[np.searchsorted(key, length * span + rank, "right") - 1].T
            i = rank - lo
            out = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence + i // copies), pa.array(offset + i % copies * length)], [*names, "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Whole documents into sequences: a row per piece with its place. A null text has the end id alone; null ids are kept."""
    return pack(staged(pieces(docs, vocabulary, capacity, end_id, keep_ids=keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (little-endian unsigned 32-bit), from pieces packed with their ids; a group holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
