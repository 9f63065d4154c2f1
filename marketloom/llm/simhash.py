"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are laid in tiles; a task compares two tiles whole, by numpy exclusive-or and bit counts.
Tile pairs are skipped where no pair within the radius can lie in them, because the population counts of the
fingerprints' parts differ by more than the radius, or, for a similarity, because the documents' sizes differ too much. Both
tests are exact: no link is lost. Of the links in a tile pair only a spanning forest leaves the task.

For a similarity of shingle sets the fingerprints only find candidates, within a radius that similar sets keep with
margin. The sets of the documents that have candidates are then compared themselves, in tiles of connected candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, columns_of, staged
from .components import components

PARTS = 4  # 16-bit parts of a fingerprint, whose population counts name its tile
TILE = 1 << 16  # fingerprints in a tile
BLOCK = 1 << 18  # pairs compared at once
HASHES = 1 << 16  # shingle hashes counted at once
HELD = 1 << 19  # shingle hashes in a tile of sets
LEAST = 4  # shingles of the smallest set that can be similar, not equal, to another one


def shingles(text: str | None, width: int) -> list[bytes]:
    """Space-joined shingles of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; of fewer words, all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), [*accumulate(len(w) + 1 for w in words)]
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :])]


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows: ``hashes`` is (n, bytes) of little-endian words, the result (bytes,)."""
    n, wide = hashes.shape
    total = np.zeros(wide * 8, np.int64)
    for at in range(0, n, HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES], axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits stay in a byte
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, wide * 8), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little")


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0 .. f<words-1> (64 bits each, as signed longs), size (shingles counted), content (hash of the word sequence).

    One word: XXH64 with seed 42 of each shingle. More: 128-bit XXH3 hashes with seeds 42, 43, ... side by side. With
    ``distinct`` a repeated shingle counts once, and ``content`` is a hash of the set of shingles, ``same`` one of the text. Null and wordless texts have fingerprint zero and size 0.
    """
    import xxhash

    rows = columns_of(docs, doc_id=id_col, text=text_col)
    names = ["doc_id", *[f"f{i}" for i in range(words)], "size", "content"]
    if distinct:
        rows, names = rows.withColumn("same", F.xxhash64("text")), [*names, "same"]

    def hashed(parts: list[bytes]) -> np.ndarray:
        if words == 1:
            one = xxhash.xxh64_digest
            return np.frombuffer(b"".join([one(p, 42) for p in parts]), ">u8").astype("<u8").view(np.uint8).reshape(-1, 8)
        one = xxhash.xxh3_128_digest
        return np.concatenate([np.frombuffer(b"".join([one(p, 42 + k) for p in parts]), np.uint8).reshape(-1, 16) for k in range(words // 2)], axis=1)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, *same in batches(it, "doc_id", "text", *names[words + 3 :]):
            out = np.zeros((len(texts), words + 2), "<i8")
            for row, text in zip(out, texts):
                parts = shingles(text, width)
                if parts:
                    row[words + 1] = np.array(xxhash.xxh64_intdigest(b"\n".join(parts), 7), "<u8").view("<i8")
                    parts = list(dict.fromkeys(parts)) if distinct else parts
                    h = hashed(parts)
                    row[:words] = majority(h).view("<i8")
                    row[words] = len(parts)
                    if distinct:
                        row[words + 1] = h.view("<i8")[:, 0].sum()  # a sum knows no order
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in out.T], *[pa.array(c, pa.int64()) for c in same]], names)

    return rows.mapInArrow(scan, ", ".join(f"{n} long" for n in names))


def part_key() -> Column:
    """Population counts of the parts of f0, as digits of base 17."""
    wide = 64 // PARTS
    return sum((F.bit_count(F.shiftrightunsigned("f0", i * wide).bitwiseAND((1 << wide) - 1)).cast("long") * 17**i for i in range(PARTS)), F.lit(0).cast("long"))


def part_neighbours(radius: int) -> list[int]:
    """Key differences of tiles that may hold pairs within the radius, one of each two opposite ones."""
    out = [(0, 0)]
    for i in range(PARTS):
        out = [(key + d * 17**i, far + abs(d)) for key, far in out for d in range(-radius, radius + 1) if far + abs(d) <= radius]
    # Digits stay in 0 .. 16 only for tiles that exist, so a difference that carries meets the wrong tile at worst, which is compared in vain.
    return sorted({k for k, _ in out if k >= 0})


def size_key(similarity: float) -> Column:
    """Sizes of similar documents differ by the factor 1 / similarity at most, hence their keys by 1."""
    return F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.log(F.lit(1 / similarity)) - 1e-9).cast("long")


def set_radius(similarity: float, bits: int) -> int:
    """Unequal bits of two fingerprints of ``bits`` bits that sets of that Jaccard similarity do not exceed.

    A bit of two equally large sets differs with probability arccos(2s / (1 + s)) / pi. Ties in small sets raise that by
    a quarter (0.152 to 0.188 at 0.8, for four of five shingles). Five standard deviations are added: of such worst
    pairs one in a million or fewer is not found, and of more similar or larger ones fewer still.
    """
    p = min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def compare(a: dict, b: dict, radius: int, similarity: float | None, first: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links between two tiles; dicts hold id, the words f0 .. and perhaps size as numpy arrays.

    Both are ordered by the population counts of f0, so a block of rows meets only a band of the other tile. Words
    after the second are compared only where the first two are within the radius already, or within ``first``. Where the tiles
    have sets, those decide: a pair not yet connected is linked if its Jaccard similarity reaches ``similarity``.
    """
    first = radius if first is None else first
    count = np.bitwise_count
    prints = [k for k in a if k[0] == "f"]

    def ordered(t):
        ones = count(t["f0"]).astype(np.int64)
        by = np.argsort(ones, kind="stable")
        return {k: x[by] for k, x in t.items()}, ones[by]

    (a, mine), (b, ones) = ordered(a), ordered(b)
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def alike(x, y) -> bool:
        both = overlap(x, y)
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    sets = {i: v for t in (a, b) for i, v in zip(t["id"].tolist(), t["hashes"])} if "hashes" in a else None
    links, at = [], 0
    step = max(1, BLOCK // max(1, len(ones)))
    while at < len(mine):
        rows = slice(at, min(at + step, len(mine)))
        at = rows.stop
        lo, hi = np.searchsorted(ones, mine[rows.start] - radius), np.searchsorted(ones, mine[rows.stop - 1] + radius, "right")
        far = count(a["f0"][rows, None] ^ b["f0"][None, lo:hi])
        for f in prints[1:2]:
            far += count(a[f][rows, None] ^ b[f][None, lo:hi])
        i, j = np.nonzero(far <= (first if len(prints) > 1 else radius))
        i, j = i + rows.start, j + lo
        if len(prints) > 2 and len(i):
            fits = sum(count(a[f][i] ^ b[f][j]).astype(np.int64) for f in prints) <= radius
            i, j = i[fits], j[fits]
        if similarity is not None and len(i):
            p, q = a["size"][i], b["size"][j]
            fits = np.minimum(p, q) >= similarity * np.maximum(p, q)
            i, j = i[fits], j[fits]
        for x, y in zip(a["id"][i].tolist(), b["id"][j].tolist()):
            p, q = find(x), find(y)
            if p != q and (sets is None or alike(sets[x], sets[y])):
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def links(nodes: DataFrame, key: Column, steps: list[int], radius: int, similarity: float | None = None, first: int | None = None, many: bool = False) -> DataFrame:
    """(u, v): links that connect whatever is within the radius. ``nodes`` has f0 .., and id and size, or f0 is the id.

    ``key`` takes few values, whatever the input (17 ** PARTS, or one for each power of a size), so its counts may be
    broadcast. A key with many nodes has many tiles, dealt by hash; every pair of tiles whose keys differ by a step is a
    row, and goes to any task. With ``many`` the key may take any number of values: nothing is broadcast by name. Nodes with
    ``hashes`` are sets, of which a tile holds HELD hashes or one node.
    """
    columns = [c for c in nodes.columns if c != "key"]
    own = F.col("id" if "id" in columns else "f0")
    keyed = staged(nodes.withColumn("key", key))
    chunks = F.ceil(F.count("*") / TILE)
    if "hashes" in columns:
        chunks = F.greatest(chunks, F.least(F.count("*"), F.ceil(F.sum("size") / HELD)))
    counts = keyed.groupBy("key").agg(chunks.cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(own), F.col("chunks")).cast("int")
    dealt = keyed.join(counts if many else F.broadcast(counts), "key").withColumn("chunk", chunk).repartition("key", "chunk")  # by both, so a hot key is spread
    tiles = staged(dealt.groupBy("key", "chunk").agg(*[F.collect_list(c).alias(c) for c in columns]))
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    other = counts.select(F.col("key").alias("key2"), F.col("chunks").alias("chunks2"))
    pairs = (
        counts.withColumn("key2", F.explode(F.array(*[F.col("key") + s for s in steps]))).join(other, "key2")
        .withColumn("chunk", numbers("chunks")).withColumn("chunk2", numbers("chunks2"))
        .where("key < key2 or chunk <= chunk2").select("key", "chunk", "key2", "chunk2")
    )
    second = tiles.select(*[F.col(c).alias(f"{c}2") for c in ["key", "chunk", *columns]])
    joined = pairs.join(second, ["key2", "chunk2"]).join(tiles, ["key", "chunk"]).select(*columns, *[f"{c}2" for c in columns])

    def tile(batch: pa.RecordBatch, row: int, suffix: str) -> dict[str, np.ndarray]:
        t = {c: batch.column(batch.schema.get_field_index(c + suffix))[row].values for c in columns}
        t = {c: np.array([np.frombuffer(v, "<u8") for v in x.to_pylist()] + [None], object)[:-1] if c == "hashes" else x.to_numpy() for c, x in t.items()}
        t.setdefault("id", t["f0"])
        return {c: x.view(np.uint64) if c[0] == "f" else x for c, x in t.items()}

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [x for r in range(batch.num_rows) for x in compare(tile(batch, r, ""), tile(batch, r, "2"), radius, similarity, first)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return joined.mapInArrow(task, "u long, v long")


def groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over fingerprints within the radius.

    Every row keeps its own row, repeated ones too. A null doc_id is grouped but never names a group with other ids. A
    text without words has fingerprint zero, and is linked like any other. An empty table gives none.
    """
    rows = staged(fingerprints(docs, width, id_col=id_col, text_col=text_col).select("doc_id", "f0"))
    nodes = rows.groupBy("f0").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("f0"), part_key(), part_neighbours(radius), radius))
    named = nodes.join(roots, nodes.f0 == roots.node, "left").select("f0", "first", F.coalesce("root", "f0").alias("root"))
    named = staged(named)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(ids, "root").select(F.col("f0").alias("_f"), "component_id")
    out = rows.join(by_print, rows.f0 == by_print._f)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, hashes: the sorted 64-bit hashes of the distinct shingles of each text, little-endian."""
    import xxhash

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, "id", "text"):
            sets = [np.unique(np.array([xxhash.xxh3_64_intdigest(p, 42) for p in set(shingles(t, width))], "<u8")).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "hashes"])

    return columns_of(docs, id=id_col, text=text_col).mapInArrow(scan, "id long, hashes binary")


def set_links(docs: DataFrame, nodes: DataFrame, prints: list[str], width: int, similarity: float, text_col: str) -> DataFrame:
    """(u, v): links that connect the nodes whose sets of shingles reach the similarity. ``nodes`` has id, f0 .., size and same."""
    radius, first = set_radius(similarity, 64 * len(prints)), set_radius(similarity, 64 * min(len(prints), 2))
    near = links(nodes.where(F.col("size") >= LEAST).select("id", *prints, "size"), size_key(similarity), [0, 1], radius, similarity, first)
    loose = components(near).select(F.col("node").alias("id"), "root")
    some = staged(nodes.join(loose, "id").select("id", *prints, "size", "same", "root"))
    # One text of each candidate, found by its hash; staged, so the candidates' size is known and they are broadcast while they are few.
    texts = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("_same"), F.col(f"`{text_col}`").alias("_text"))
    texts = texts.join(some.select(F.col("same").alias("_same")), "_same", "left_semi")
    sets = shingle_sets(texts, width, "_same", "_text").groupBy("id").agg(F.first("hashes").alias("hashes"))
    sets = some.join(sets.withColumnRenamed("id", "same"), "same").select("id", *prints, "size", "hashes", F.col("root").alias("key"))
    return links(sets, F.col("key"), [0], radius, similarity, first, many=True)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4, verified: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one left of each near-duplicate group, the one with the smallest id, columns unchanged.

    Fingerprints of 64 x ``words`` bits over the distinct shingles of ``width`` words. ``verified``: two documents are
    near-duplicates if the Jaccard similarity of their sets of shingles is at least ``similarity``. The fingerprints find
    candidates at ``set_radius``; of documents that have any, the sets of 64-bit shingle hashes are compared. Else the share of
    equal bits decides, with the ratio of the numbers of shingles, which links many less similar pairs. Documents with the same set
    always are. Wordless texts are one group. Of repeated rows with one id, one stays. A document with a null id cannot be
    named, so it stays; of such rows with equal texts, one.
    """
    prints = [f"f{i}" for i in range(words)]
    rows = staged(fingerprints(docs, width, words, distinct=True, id_col=id_col, text_col=text_col))
    nodes = rows.groupBy("content", *prints, "size").agg(F.min("doc_id").alias("first"), F.min("same").alias("same"))
    nodes = staged(nodes.withColumn("id", F.xxhash64("content", *prints, "size")))
    if verified:
        found = set_links(docs, nodes, prints, width, similarity, text_col)
    else:
        found = links(nodes.select("id", *prints, "size"), size_key(similarity), [0, 1], int((1 - similarity) * 64 * words + 1e-9), similarity)
    roots = components(found)
    named = nodes.join(roots, nodes.id == roots.node, "left").select("first", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("_keep")).select("_keep")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    mine = docs.select(whole, F.col(f"`{id_col}`").alias("_id"), F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.col(f"`{text_col}`"))).alias("_null"))
    stay = mine.join(best, mine._id == best._keep, "left_semi").unionByName(mine.where("_id is null"))
    return stay.dropDuplicates(["_id", "_null"]).select("_doc.*")
