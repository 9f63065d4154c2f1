"""WARC archives with revisit records for repeated payloads.

Headers are grouped by payload digest; in each group the smallest page_id keeps its payload and the others become
revisit records that name it. Archives are gzip files with one member per record, so a reader can start at any
record; every response's digest is checked on reading.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns_of, fresh_dir, open_fs, staged, write_atomic

BROADCAST_BYTES = 64 << 20  # of shared digests with their originals, measured; more are joined by a shuffle
FILE_BYTES = 1 << 30  # payload bytes after which a task starts another archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
HEADS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hexadecimal digits are four of base 32."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Decide each capture's record: adds payload_digest, payload_bytes, record_type, refers_to and refers_url.

    ``captures`` has page_id, url, html. A null payload is empty. Payloads of at least ``min_bytes`` bytes are shared;
    smaller ones are all responses. The smallest page_id of equal payloads is the response, null being the largest;
    rows that repeat that page_id and payload are responses too. An empty table stays empty.

    Headers alone are shuffled by digest: each digest that occurs twice or more becomes one row, summed before the shuffle and
    stored. These rows go to all tasks while they measure at most BROADCAST_BYTES, so that payloads stay where they are; beyond
    that they are joined by a shuffle, in which a digest that many captures share is a skewed left side, split by adaptive execution.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = captures.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), digest(payload).alias("payload_digest"))
    headers = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")).alias("_of"))
    originals = staged(
        headers.groupBy("payload_digest").agg(F.min("_of").alias("_of"), F.count("*").alias("copies"))
        .where("copies > 1").select(F.col("payload_digest").alias("shared"), F.col("_of.page_id").alias("original"), F.col("_of.url").alias("original_url"))
    )
    size = originals.agg(F.sum(F.coalesce(F.octet_length("original_url"), F.lit(0)) + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        originals = F.broadcast(originals)
    # ``original <=> page_id`` keeps rows without an id apart only if another row has one.
    revisit = F.col("shared").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    joined = rows.join(originals, rows.payload_digest == originals.shared, "left")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("refers_url"),
    )


def target(url: str) -> str:
    """URL as a header value: what is not printable ASCII is percent-encoded."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))), errors="surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, kind: str, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """One WARC record with fresh headers; a revisit has no payload. Where the URL had to be encoded, X-Target-URI-JSON keeps it as it was."""
    name = lambda p: f"<urn:uuid:{uuid.uuid5(SPACE, f'{p} {sha}')}>"
    body = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head += [f"WARC-Target-URI: {target(url)}"] + [f"X-Target-URI-JSON: {json.dumps(url)}"] * (target(url) != url)
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        head += [f"WARC-Refers-To-Target-URI: {target(refers_url)}"] if refers_url is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(resolved: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write one record per row into archives of bounded size; returns their manifest (path, records), already stored. ``date`` is now if not given."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def archives(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (r for columns in batches(it, "page_id", "url", "html", "payload_digest", "record_type", "refers_to", "refers_url") for r in zip(*columns))
        row = next(rows, None)
        while row is not None:
            path, count = f"{folder}/part-{part:06d}-{number:04d}.warc.gz", 0

            def body(out):
                nonlocal row, count
                size = 0
                while row is not None and size < FILE_BYTES:
                    page_id, url, html, sha, kind, refers_to, refers_url = row
                    data = html.encode("utf-8", "surrogatepass")
                    out.write(member(record(page_id, url, data, sha, kind, refers_to, date, refers_url)))
                    size, count, row = size + len(data), count + 1, next(rows, None)

            write_atomic(path, body)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return staged(resolved.mapInArrow(archives, "path string, records long"))


def members(source) -> Iterator[bytes]:
    """Records of an archive, one gzip member at a time."""
    data = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            data = data or source.read(1 << 20)
            if not data:
                if out:
                    raise ValueError("archive cut short")
                return
            out.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; checks lengths, and a response's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields.get('WARC-Record-ID')} differs")
    return fields, payload


def read(spark: SparkSession, manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, and html if asked for."""
    paths = [r.path for r in manifest.select("path").collect()]
    schema = HEADS + ", html string" * payload
    if not paths:
        return spark.createDataFrame([], schema)
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (names,) in batches(it, "path"):
            for name in names:
                where, path = open_fs(name)
                out, size = [], 0
                with where.open_input_stream(path, compression=None) as source:
                    for data in members(source):
                        f, body = parse(data)
                        number = lambda k, f=f: int(f[k]) if k in f else None
                        url = json.loads(f["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in f else f.get("WARC-Target-URI")
                        row = [number("X-Page-ID"), url, f["WARC-Type"], f["WARC-Payload-Digest"][5:], number("X-Payload-Length"), number("X-Refers-To-Page-ID")]
                        if payload:
                            row.append(body.decode("utf-8", "surrogatepass") if f["WARC-Type"] == "response" else None)
                            size += len(body)
                        out.append(row)
                        if len(out) >= 4096 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), fields)], schema=fields)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), fields)], schema=fields)

    # The list has one path per archive; each becomes a task.
    listed = spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], len(paths)), "path string")
    return listed.mapInArrow(records, schema)


def deduplicate(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Resolve, write the archives to the shared folder, and read their records back."""
    spark = pages.sparkSession
    captures = columns_of(pages, page_id=id_col, url=url_col, html=html_col)
    return read(spark, write(resolve(captures, min_bytes), fresh_dir(spark, "warc")))
