"""Token files in Simple-8b: a varying number of ids in each 64-bit word.

The top four bits of a word are its selector; it says how many ids of how many bits the other sixty hold. Ids
of more than sixty bits are escapes: selector 0, with the place of the id in a table of raw values. Ids are cut into
blocks of 1024, each of which starts on a word, so any block can be decoded alone and many at once with numpy.

File: ``S8B1`` | words | raw values | block word offsets (uint64, one more than blocks) | document ids (int64) |
null flags of the ids (uint8) | ids in each document (uint64) | eight uint64 of the footer | ``S8B1``.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns_of, fresh_dir, open_fs, parallelism, staged, write_atomic
from .encoding import encoder

MAGIC = b"S8B1"
BLOCK = 1024
# Fixed values of the coding: ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ROWS = 512  # documents in an Arrow batch of the output
GROUP = 1024  # blocks encoded or decoded at once


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, raw escaped values) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)
    values = np.zeros((blocks, BLOCK + 128), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    if int(ids.max()) < 1 << 24:  # single floats are exact, and their exponents the widths
        width = np.maximum((values.astype(np.float32).view(np.uint32) >> np.uint32(23)).astype(np.int16) - 126, 0).astype(np.uint8)
    else:
        width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    selector = np.where(width[:, :BLOCK] > 60, 0, 15).astype(np.uint8)
    widest = {1: width}
    for s in range(14, 0, -1):
        n, bits = int(COUNTS[s]), int(BITS[s])
        k = max(x for x in widest if x >= n - x)
        m = widest[k].copy()
        np.maximum(m[:, : m.shape[1] - (n - k)], widest[k][:, n - k :], out=m[:, : m.shape[1] - (n - k)])
        widest[n] = m
        np.copyto(selector, np.uint8(s), where=m[:, :BLOCK] <= bits)
    lanes, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    size = np.full(blocks, BLOCK)
    size[-1] = len(ids) - (blocks - 1) * BLOCK
    while True:
        live = at < size
        if not live.any():
            break
        s = np.where(live, selector[lanes, np.minimum(at, BLOCK - 1)], 255)
        steps.append((at.copy(), s))
        at = at + np.where(live, COUNTS[np.minimum(s, 15)], 0)
    start = np.stack([a for a, _ in steps], axis=1)
    chosen = np.stack([s for _, s in steps], axis=1)
    used = chosen != 255
    offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.uint64)
    lane = np.broadcast_to(lanes[:, None], used.shape)[used]
    start, chosen = start[used], chosen[used]
    flat, at = values.reshape(-1), lane * values.shape[1] + start
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 16):
        here = np.flatnonzero(chosen == s)
        if len(here) and BITS[s]:
            place, word = at[here], words[here]
            for j in range(int(COUNTS[s])):
                word |= flat.take(place + j) << np.uint64(j * BITS[s])
            words[here] = word
    raw = np.flatnonzero(chosen == 0)
    words[raw] |= np.arange(len(raw), dtype=np.uint64)
    return words, offsets, values[lane[raw], start[raw]]


def decode(words: np.ndarray, offsets: np.ndarray, total: int, raw: np.ndarray) -> np.ndarray:
    """Ids of whole blocks: ``offsets`` are the blocks' word offsets within ``words``, ``total`` the ids in them."""
    if not total:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(COUNTS[selector])])
    out = np.zeros(place[-1] + BLOCK, np.uint64)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[place[here]] = raw[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            mask, w, to = np.uint64((1 << int(BITS[s])) - 1), words[here], place[here]
            for j in range(int(COUNTS[s])):
                out[to + j] = (w >> np.uint64(j * BITS[s])) & mask
    first = place[offsets[:-1].astype(np.int64)]
    return out[first[:, None] + np.arange(BLOCK)].reshape(-1)[:total]


class Writer:
    """Streams one file; keeps only offsets and the document table in memory."""

    def __init__(self, out):
        self.out, self.parts, self.kept = out, [], 0
        self.offsets, self.words, self.raw = [np.zeros(1, np.uint64)], 0, []
        self.docs: list[tuple[int, int, int]] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes, item: str = "<u4") -> None:
        part = np.frombuffer(ids, item)
        self.docs.append((doc_id or 0, doc_id is None, len(part)))
        self.parts.append(part)
        self.kept += len(part)
        self.ids += len(part)
        if self.kept >= GROUP * BLOCK:
            self.flush(self.kept // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        for at in range(0, upto, GROUP * BLOCK):
            words, offsets, raw = encode(ids[at : min(upto, at + GROUP * BLOCK)])
            escapes = sum(map(len, self.raw))
            if escapes and len(raw):
                words[words >> np.uint64(60) == 0] += np.uint64(escapes)
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(offsets[1:] + np.uint64(self.words))
            self.words += len(words)
            self.raw.append(raw)
        self.parts, self.kept = [ids[upto:].copy()], len(ids) - upto

    def close(self) -> None:
        self.flush(self.kept)
        offsets, raw = np.concatenate(self.offsets), np.concatenate([np.empty(0, np.uint64), *self.raw])
        doc, null, size = (list(x) for x in zip(*self.docs)) if self.docs else ([], [], [])
        for a, kind in ((raw, "<u8"), (offsets, "<u8"), (doc, "<i8"), (null, "u1"), (size, "<u8")):
            self.out.write(np.array(a).astype(kind).tobytes())
        self.out.write(np.array([1, BLOCK, self.words, len(raw), len(offsets), len(self.docs), self.ids, 0], "<u8").tobytes() + MAGIC)


class Reader:
    """Reads a file's tables, then its blocks a group at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(64 + len(MAGIC), size - 64 - len(MAGIC))
        if tail[-4:] != MAGIC or source.read_at(4, 0) != MAGIC:
            raise ValueError("not a Simple-8b token file, or cut short")
        version, block, self.words, raw, offsets, docs, self.ids, _ = (int(x) for x in np.frombuffer(tail[:64], "<u8"))
        if version != 1 or block != BLOCK:
            raise ValueError(f"version {version} with blocks of {block}")
        at = len(MAGIC) + 8 * self.words

        def take(n, kind):
            nonlocal at
            a = np.frombuffer(source.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += a.nbytes
            return a

        self.raw, self.offsets = take(raw, "<u8"), take(offsets, "<u8")
        self.doc_ids, self.nulls, self.sizes = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u8")

    def blocks(self, start: int, stop: int) -> np.ndarray:
        """Ids of the blocks start .. stop-1, by their offsets alone."""
        lo, hi = int(self.offsets[start]), int(self.offsets[stop])
        words = np.frombuffer(self.source.read_at(8 * (hi - lo), len(MAGIC) + 8 * lo), "<u8")
        total = min(self.ids, stop * BLOCK) - start * BLOCK
        return decode(words, self.offsets[start : stop + 1] - np.uint64(lo), total, self.raw)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, first id's place in the file, its ids as pieces of little-endian uint32)."""
        count, at, held, ids = len(self.offsets) - 1, 0, 0, np.empty(0, "<u4")
        done = 0

        def pieces(n):
            nonlocal at, held, ids, done
            while n:
                if held == len(ids):
                    stop = min(count, at + GROUP)
                    ids, held = self.blocks(at, stop).astype("<u4"), 0
                    at = stop
                k = min(n, len(ids) - held)
                yield ids[held : held + k].tobytes()
                held, n, done = held + k, n - k, done + k

        for doc_id, null, n in zip(self.doc_ids, self.nulls, self.sizes):
            start, rest = done, pieces(int(n))
            yield None if null else int(doc_id), start, rest
            for _ in rest:
                pass


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending id order.

    Returns the manifest, one row per file: shard, path, docs, ids. Rows are ranged on (id, hash of the text), so
    an id that a third of the rows share is still spread. A null text has only the end id; null ids come first;
    rows with one id follow each other in the order of their texts' hashes; each repeated row is written. An empty table
    gives no file. Other columns are not read.
    """
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parallelism(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], "<u4").tobytes()

    def shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes = TaskContext.get().partitionId(), encoder(vocabulary)
        first = next(it, None)
        if first is None:
            return
        path = f"{folder}/shard-{number:06d}.s8b"
        counts = {}

        def body(out):
            w = Writer(out)
            for batch in (b for part in ([first], it) for b in part):
                for doc_ids, texts in batches([batch], "doc_id", "text"):
                    for doc_id, ids in zip(doc_ids, codes.each(texts)):
                        w.add(doc_id, ids + end)
            w.close()
            counts.update(docs=len(w.docs), ids=w.ids)

        write_atomic(path, body)
        yield pa.RecordBatch.from_pylist([{"shard": number, "path": path, "docs": counts["docs"], "ids": counts["ids"]}],
                                         pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return staged(rows.select("doc_id", "text").mapInArrow(shard, "shard long, path string, docs long, ids long"))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row per file; the running count over it places each file.
    """
    files, start = [], 0
    for f in sorted(manifest.collect(), key=lambda f: f.shard):
        files.append((f.path, start))
        start += f.ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def docs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, starts in batches(it, "path", "base"):
            for path, base in zip(paths, starts):
                where, name = open_fs(path)
                with where.open_input_file(name) as source:
                    out: list[tuple] = []
                    for doc_id, at, pieces in Reader(source).documents():
                        n, crc = 0, 0
                        for p in pieces:
                            n, crc = n + len(p) // 4, zlib.crc32(p, crc)
                        out.append((doc_id, base + at, n, crc))
                        if len(out) >= ROWS * 16:
                            yield as_batch(out)
                            out = []
                    if out:
                        yield as_batch(out)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # The list has one short row per file, which the writers returned; each becomes a task.
    listed = spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "path string, base long")
    return listed.mapInArrow(docs, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the token files to the shared folder and read their documents back."""
    spark = docs.sparkSession
    return read(spark, write(docs, fresh_dir(spark, "tokens"), vocabulary))


def dumps(documents: list[tuple[int | None, list[int]]], item: str = "<u4") -> bytes:
    """One file in memory, for small sets."""
    out = io.BytesIO()
    w = Writer(out)
    for doc_id, ids in documents:
        w.add(doc_id, np.array(ids, item).tobytes(), item)
    w.close()
    return out.getvalue()
