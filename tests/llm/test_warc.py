import gzip
import hashlib
import io

from graphloom.llm.common import scratch_path
from graphloom.llm.warc import decode_http, op9_warc, page_records, read_records, read_warc, write_warc


def want(pages):
    first = {}
    for p, t in pages:
        b = (t or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, t in pages:
        b = (t or "").encode()
        to = first.get(b) if p is not None and first.get(b, p) != p else None
        out.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", str(to), True))
    return sorted(out)


def rows(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.complete) for r in df.collect())


def test_round_trip(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows(op9_warc(spark, sf)) == want(pages)


def test_edges(spark, table):
    pages = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "é" * 50), (6, "é" * 50), (6, "é" * 50), (5, "é" * 50), (None, "é" * 50), (7, "line\r\n\r\nWARC/1.1\r\n" * 20), (8, "😀" * 60_000), (9, "😀" * 60_000), (10, "b\x00\n" * 50_000)]
    d = table("pages", [(p, "http://a\r\nb", t, "x") for p, t in pages], "page_id long, url string, html string, digest string")
    assert rows(op9_warc(spark, d)) == want(pages)
    path = scratch_path(spark, "t")
    write_warc(spark.read.parquet(f"{d}/pages.parquet"), path, segment_bytes=700)
    back = read_warc(spark, path, payloads=True)
    assert rows(back) == want(pages)
    for r in back.collect():
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and r.url == "http://a%0D%0Ab"
    d = table("pages", [], "page_id long, url string, html string")
    assert op9_warc(spark, d).count() == 0


def test_lost_segment(spark, tmp_path):
    records = list(page_records(1, "u", b"0123456789" * 100, hashlib.sha256(b"0123456789" * 100).hexdigest(), None, 300))
    assert len(records) > 3
    for name, kept in (("whole", records[::-1]), ("part", records[:1] + records[2:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(b"".join(kept)))
    assert [(r.complete, r.payload_bytes) for r in read_warc(spark, str(tmp_path / "whole")).collect()] == [(True, 1000)]
    assert [(r.complete, r.payload_bytes, r.payload_digest) for r in read_warc(spark, str(tmp_path / "part")).collect()] == [(False, None, None)]


def test_framing():
    for text in (b"", b"x", "é".encode() * 5000):
        digest = "0" * 64
        (record,) = page_records(1, None, text, digest, None, 1 << 20)
        ((headers, block),) = read_records(io.BytesIO(record))
        http, body = decode_http(block)
        assert body == text and http["transfer-encoding"] == "chunked" and headers["x-page-id"] == "1"
