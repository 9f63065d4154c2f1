import base64
import gzip
import hashlib

import pytest

from marketloom.llm import warc
from marketloom.llm.common import fresh_dir

PAGES = [(3, "http://a/é?x=1\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"), (2, "u2", "same"), (9, None, "same"), (7, "u", "same"), (4, "u4", None), (5, "u5", ""), (None, "n", "same"), (2, "u2", "same"), (6, "u6", "long " * 5000)]
KIND = "page_id long, url string, html string"


def expected(rows, least=0):
    out = []
    for page, _, body in rows:
        data = (body or "").encode()
        first = min((p for p, _, b in rows if (b or "") == (body or "") and p is not None), default=None)
        revisit = len(data) >= least and first != page
        out.append((page or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, bound", [(0, 1 << 20), (0, 0), (1, 1 << 20), (5, 0)])
def test_revisits_name_the_smallest_page(spark, monkeypatch, least, bound):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(*r, "x", "y") for r in PAGES], KIND + ", record_type string, original string")
    got = warc.deduplicate(df, least).collect()
    assert sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES, least)
    assert sorted(str(r.url) for r in got) == sorted(str(u) for _, u, _ in PAGES)


def test_archives_are_gzip_members_with_whole_payloads(spark):
    df = spark.createDataFrame(PAGES, KIND)
    folder = fresh_dir(spark, "warc-test")
    manifest = warc.write(warc.resolve(df), folder)
    back = warc.read(spark, manifest, payload=True).collect()
    assert all(r.html == next(b or "" for p, _, b in PAGES if p == r.page_id) for r in back if r.record_type == "response")
    assert all(r.html is None for r in back if r.record_type == "revisit")
    for m in manifest.collect():
        data = gzip.decompress(open(m.path.removeprefix("file:"), "rb").read())
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Type: ") == m.records


def test_headers_are_fresh_and_plain(spark):
    """Any URL is a valid header and comes back as it was; a revisit names its original's URL and date."""
    urls = ["http://a/é?x=1\r\nX: y", "http://a/100%25 b", "", None, "http://b/plain", "http://b/\ud7ff\U0001f600"]
    df = spark.createDataFrame([(i, u, "same") for i, u in enumerate(urls)], KIND)
    manifest = warc.write(warc.resolve(df), fresh_dir(spark, "warc-test"), "2024-05-06T07:08:09Z")
    assert {r.page_id: r.url for r in warc.read(spark, manifest).collect()} == dict(enumerate(urls))
    seen = 0
    for m in manifest.collect():
        with gzip.open(m.path.removeprefix("file:")) as f:
            for head in f.read().split(b"WARC/1.1\r\n")[1:]:
                lines = head.partition(b"\r\n\r\n")[0].decode("ascii").split("\r\n")
                fields = dict(line.split(": ", 1) for line in lines)
                assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and " " not in fields.get("WARC-Target-URI", "")
                if fields["WARC-Type"] == "revisit":
                    assert (fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"]) == ("http://a/%C3%A9?x=1%0D%0AX:%20y", "2024-05-06T07:08:09Z")
                    seen += 1
    assert seen == len(urls) - 1


def test_payloads_are_not_shuffled(spark):
    df = spark.createDataFrame(PAGES, KIND)
    assert "Exchange hashpartitioning" not in warc.resolve(df)._jdf.queryExecution().executedPlan().toString()


def test_files_roll_at_their_size(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 10)
    df = spark.createDataFrame([(i, "u", "x" * 8) for i in range(9)], KIND).coalesce(1)
    manifest = warc.write(warc.resolve(df, min_bytes=100), fresh_dir(spark, "warc-test"))
    assert sum(r.records for r in manifest.collect()) == 9 and warc.read(spark, manifest).count() == 9


def test_changed_payloads_are_refused():
    data = warc.record(1, "u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "response", None, "1970-01-01T00:00:00Z")
    assert warc.parse(data)[1] == b"abc"
    for bad in (data.replace(b"abc", b"abd"), data[:-1], data.replace(b"WARC/1.1", b"WARC/0.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_empty_table(spark):
    assert warc.deduplicate(spark.createDataFrame([], KIND)).count() == 0
