"""WARC archives written and read back with record segments, chunked transfer framing and revisit records.

Writing: a record of more than SEGMENT_BYTES goes out as a first segment and continuation records. Half of the responses (by the
first digit of their digest) frame their payload in HTTP chunks. Archives are gzip files that Spark's text sink writes to the shared
folder, RECORDS_PER_FILE records each, so a file's size is bounded whatever the pages' sizes are.

Reading: each archive is streamed record by record. Continuation records are grouped by the record that they continue, put in the
order of their segment numbers, and their length is held against the total that the last one states; then chunks are joined.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page id is the response and the others
revisit it; hot payloads cost a row each, as only digests are grouped.

Defined results: a null html is an empty payload; rows that repeat an id and payload are each a record of its own, all of the same type;
a null page id is neither a response that others refer to nor a revisit; a record whose segments don't add up has
complete = false and a null digest. Line breaks in an url are written as %0D and %0A.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read_table, scratch_path, small_batches, staged

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE, MIN_REVISIT = 32 * 1024, 4096, 4000, 100
#: The list of repeated payloads is broadcast up to this length (about 100 bytes each); a longer one is joined by a shuffle.
BROADCAST_DIGESTS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "graphloom:warc")


def record_id(page_id, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{kind}')}>"


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most size bytes; no UTF-8 sequence is cut, as the text sink takes strings."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(page_id, url: str | None, payload: bytes, digest: str, refers_to, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page: one, or a first segment and its continuations."""
    kind = "response" if refers_to is None else "revisit"
    me = record_id(page_id, digest, kind)
    chunked = kind == "response" and int(digest[0], 16) % 2 == 0
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Transfer-Encoding: chunked\r\n\r\n" if chunked else b"Content-Length: %d\r\n\r\n" % len(payload))
    if kind == "revisit":
        body = b""
    elif chunked:
        body = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, CHUNK_BYTES)) + b"0\r\n\r\n"
    else:
        body = payload
    block = http + body
    common = [("WARC-Type", kind), ("WARC-Record-ID", me), ("WARC-Date", DATE)]
    if url is not None:
        common.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        common.append(("X-Page-Id", page_id))
    common += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        common += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("X-Refers-To-Page-Id", refers_to)]
    parts = list(_cuts(block, segment_bytes))
    if len(parts) == 1:
        yield _record(common, block)
        return
    yield _record([*common, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, str(k))), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", k)]
        yield _record(more + [("WARC-Segment-Total-Length", len(block))] * (k == len(parts)), part)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def decode_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and the body without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    at, out = 0, []
    while at < len(body):
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return headers, b"".join(out)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for each page to gzip archives under path."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where((F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    repeated = staged(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "payloads")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def records(batches):
        for b in batches:
            out = [r[:-2].decode() for p, u, h, d, to in zip(*(x.to_pylist() for x in b.columns)) for r in page_records(p, u, h.encode(), d, to, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # the sink's line separator ends each record
    rows.mapInArrow(records, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "complete": pa.bool_(), "payload": pa.binary()}
_SEGMENT = {"origin": pa.string(), "number": pa.int64(), "total": pa.int64(), "data": pa.binary()}
_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean, payload binary"


def _number(x: str | None) -> int | None:
    return int(x) if x else None


def _row(headers: dict[str, str], block: bytes | None, payloads: bool) -> tuple:
    page, kind, url, to = _number(headers.get("x-page-id")), headers["warc-type"], headers.get("warc-target-uri"), _number(headers.get("x-refers-to-page-id"))
    if block is None:
        return page, url, None, None, kind, to, False, None
    stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    http, body = decode_http(block)
    if kind == "revisit":
        return page, url, _number(http.get("content-length")), stated, kind, to, True, None
    digest = hashlib.sha256(body).hexdigest()
    return page, url, len(body), digest, kind, to, not stated or digest == stated, body if payloads else None


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


def read_warc(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """A row per response or revisit in the archives under path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, complete and, if asked for, payload."""
    small_batches(spark)

    def parse(batches):
        kinds = _FIELDS | _SEGMENT
        for b in batches:
            for content in b.column("content"):
                rows = []
                held = 0
                for headers, block in read_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if headers.get("warc-type") == "continuation":
                        rows.append((None,) * len(_FIELDS) + (headers.get("warc-segment-origin-id"), _number(headers.get("warc-segment-number")), _number(headers.get("warc-segment-total-length")), block))
                    elif headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    elif headers.get("warc-segment-number"):
                        # the headers travel in front of the first segment
                        row = _row(headers, None, payloads)
                        rows.append((*row[:3], headers.get("warc-payload-digest", "").removeprefix("sha256:"), *row[4:], headers.get("warc-record-id"), 1, None, block))
                    else:
                        rows.append(_row(headers, block, payloads) + (None,) * len(_SEGMENT))
                        block = rows[-1][7] or b""
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 4000:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                yield _batch(rows, kinds)

    def assemble(batches):
        for b in batches:
            rows = []
            for segments in b.column("segments").to_pylist():
                firsts = [s for s in segments if s["number"] == 1]
                parts = {s["number"]: s["data"] for s in segments}
                total = next((s["total"] for s in segments if s["total"] is not None), None)
                whole = b"".join(parts.get(k, b"") for k in range(1, len(parts) + 1))
                good = total == len(whole) and set(parts) == set(range(1, len(parts) + 1))
                for s in firsts:
                    headers = {"warc-type": s["record_type"], "warc-payload-digest": s["payload_digest"] or ""} | {k: str(v) for k, v in (("x-page-id", s["page_id"]), ("warc-target-uri", s["url"]), ("x-refers-to-page-id", s["refers_to"])) if v is not None}
                    rows.append(_row(headers, whole if good else None, payloads))
            yield _batch(rows, _FIELDS)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = staged(archives.mapInArrow(parse, _DDL + ", origin string, number long, total long, data binary"), "records")
    names = list(_FIELDS)
    segments = parsed.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "data", "page_id", "url", "payload_digest", "record_type", "refers_to")).alias("segments"))
    out = parsed.where("origin is null").select(names).unionByName(segments.select("segments").mapInArrow(assemble, _DDL))
    return out if payloads else out.drop("payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives as read back: payload bytes and digest, record type, and what a revisit refers to."""
    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < d.page_id THEN first END AS refers_to, true AS complete
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
