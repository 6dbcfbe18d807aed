"""WARC 1.1 archives: write captures of pages, read them back, assemble transactions.

A capture is a request, a response or revisit, and a metadata record. Request
and metadata name the response in ``WARC-Concurrent-To``; assembly joins the
three over it to one nested row per capture.

Archives are written by Spark's text writer with a line end that completes each
record, so they go to any file system Spark knows, with its commit protocol.
Pages are written by size class, each class in a folder of its own, with as many
captures in a gzip file as keep it under ``file_bytes`` before compression; only a
page larger than that has a bigger file, to itself. Files are inflated as a stream
and parsed by Content-Length, so a reader holds a compressed file and a record.

Null html is an empty payload. Of records with equal payloads of at least
``least_bytes`` bytes the one with the smallest page id is the response (rows
that share that id all are), others revisit it; rows with a null id revisit
unless all are null. Line breaks in urls are percent-encoded in the archive.
Repeated rows are captures of their own. Payloads are written whole; a page and its
headers must fit one string value of Spark (under 1 GiB). Page ids must be castable
to bigint. Only id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop_at_exit, materialise, shared_dir, table, text_or_empty

CAPTURES_PER_FILE = 8192
FILE_BYTES = 256 << 20
#: The first size class holds payloads of at most this many bytes, each next one eight times as many.
LEAST_CLASS, CLASSES = 1 << 16, 6
#: Room for the headers of a capture, and bytes of records that the reader hands on at once.
HEADERS, BATCH_BYTES = 4096, 16 << 20
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload: Column) -> Column:
    """``digest_of`` from built-in functions: five hex digits are four base32 ones."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _size_class(size: Column) -> Column:
    out = F.lit(CLASSES)
    for c in reversed(range(CLASSES)):
        out = F.when(size <= LEAST_CLASS << 3 * c, F.lit(c)).otherwise(out)
    return out


def _record(kind: str, fields: list[tuple[str, Column | str]], body: Column) -> Column:
    """One record without its last line end; null fields are left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, captures_per_file: int = CAPTURES_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    payload = text_or_empty(html)
    base = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", digest_column(F.col("payload")))
    base = base.withColumn("mark", F.substring(F.md5(F.concat_ws("|", F.coalesce("url", F.lit("")), "digest").cast("binary")), 1, 16))
    size = F.octet_length("payload")
    # Which payloads occur more than once: ids only, partly summed before the shuffle.
    firsts = (
        base.filter(size >= least_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "mark"))).alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first")
    )
    firsts = materialise(firsts)
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = base.join(firsts, "digest", "left")
    revisit = (size >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    name = lambda i, mark, kind: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), mark, F.lit(f":{kind}>"))
    own = name(F.col("id"), F.col("mark"), "response")
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    host = F.coalesce(F.regexp_extract(target, r"://([^/?#]*)", 1), F.lit(""))
    rest = F.coalesce(F.regexp_extract(target, r"://[^/?#]*([^#]*)", 1), F.lit("/"))
    request = _record(
        "request",
        [("WARC-Record-ID", name(F.col("id"), F.col("mark"), "request")), ("WARC-Target-URI", target), ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), rest, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    known = [("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response")]
    response = _record("response", known, F.concat(http, F.col("payload")))
    again = _record(
        "revisit",
        [*known, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(F.col("first.id"), F.col("first.mark"), "response"))],
        http,
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", name(F.col("id"), F.col("mark"), "metadata")), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-length: "), size.cast("string"), F.lit("\r\n")),
    )
    end = F.lit("\n")
    captures = rows.select(F.concat(request, end, F.when(revisit, again).otherwise(response), end, metadata).alias("value"), _size_class(size).alias("class"))
    there = [r["class"] for r in base.select(_size_class(size).alias("class")).distinct().collect()]  # at most CLASSES + 1
    for c in sorted(there) or [0]:
        own = 1 if c == CLASSES else min(captures_per_file, max(1, file_bytes // ((LEAST_CLASS << 3 * c) + HEADERS)))
        chosen = captures.filter(F.col("class") == c).select("value")
        chosen.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", own).text(f"{path}/size_{c}")


def parse_records(data: bytes):
    """(headers, block) of each record of an archive, gzip members or plain, inflated as it is read."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is longer or shorter than it says")
        yield headers, block


RECORDS = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("declared_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())])
RECORDS_SQL = "kind string, record_id string, concurrent_to string, refers_to string, url string, declared_digest string, payload_digest string, payload_bytes long, fields string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. Digest and length are those of the payload as read;
    ``payloads`` false leaves the bytes themselves out."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse_records(content.as_py()):
                    kind = h["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    rows.append((
                        kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if payload is None else digest_of(payload),
                        None if payload is None else len(payload), block.decode("utf-8", "replace") if kind in ("request", "metadata") else None,
                        payload if payloads else None,
                    ))
                    held += len(payload) if payloads and payload else 256
                    if held >= BATCH_BYTES or len(rows) >= 2048:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORDS_SQL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response or revisit, with the request and
    metadata record that name it in WARC-Concurrent-To."""
    sides = records.filter("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id")).agg(
        F.max(F.when(F.col("kind") == "request", F.struct("record_id", "url", "fields"))).alias("request"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )
    main = records.filter("kind in ('response', 'revisit')").select(
        "record_id", F.struct("kind", "record_id", "url", "refers_to", "declared_digest", "payload_digest", "payload_bytes", "payload").alias("response")
    )
    return main.join(sides, "record_id", "left").select(F.col("record_id").alias("capture_id"), "request", "response", "metadata")


def _field(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"(?m)^{name}: (-?\d+)\r?$", 1)
    return F.when(found != "", found).cast("bigint")


def op5_warc(spark, sf_dir):
    path = drop_at_exit(spark, shared_dir(spark))
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path, payloads=False))
    page_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    return captures.select(
        _field(F.col("metadata.fields"), "page-id").alias("page_id"),
        F.coalesce("response.payload_bytes", _field(F.col("metadata.fields"), "payload-length")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), page_of(F.col("response.refers_to"))).cast("bigint").alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), bits AS (
  SELECT page_id, h, x, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][position(x[i] IN '0123456789abcdef')]), '') AS b FROM p
), digests AS (
  SELECT page_id, octet_length(encode(h)) AS n, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5*i+1] AS INT) + 8 * CAST(b[5*i+2] AS INT) + 4 * CAST(b[5*i+3] AS INT) + 2 * CAST(b[5*i+4] AS INT) + CAST(b[5*i+5] AS INT)]), '') AS d FROM bits
), firsts AS (
  SELECT d, min(page_id) AS f FROM digests GROUP BY d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM digests JOIN firsts USING (d)
"""
