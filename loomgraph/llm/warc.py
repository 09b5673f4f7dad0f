"""WARC archives with revisit records.

Headers (id, digest, length) are aggregated by payload digest, each record is joined to the original of its digest, and
the archives are written by Spark's text writer: a record is one string whose separator is the CRLF CRLF that ends a
WARC record, so plain executors write valid archives to any store. Every record gets fresh headers.

Defined cases: null payload: an empty one, always ``response``. Null id: kept, written under a
random record id and always ``response``, reads back as null. All records of a write bear its time. Equal payloads under the same id (repeated rows): each is ``response``. Payloads under ``least`` bytes are never
shared. Further columns of the input are ignored. Empty input: an archive folder without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END


def resolve(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """id, url, payload, bytes, digest, and ``refers_to``: the smallest id with the same payload, null for originals.

    Only (digest, id) go through the aggregation, combined before the shuffle; a digest that a third of all rows share
    is one row of the smaller side, and the join may split its rows on the other side.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    p = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = (
        p.where((F.col("bytes") >= least) & F.col("id").isNotNull())
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = p.join(shared, (p.digest == shared.d) & (p.bytes >= least), "left")
    return joined.withColumn("refers_to", F.when(F.col("id") != F.col("original"), F.col("original"))).drop("d", "original")


def write(resolved: DataFrame, path: str, records_per_file: int = 5000, at: datetime | None = None) -> None:
    """Write gzip archives dated ``at`` (now if not given); a revisit has headers and no payload."""
    date = (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    # a URL's own line breaks would end its header line
    target = F.nullif(F.regexp_replace("url", r"[\r\n]+", "%0A"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))), F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", target), line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    w = resolved.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", END)
    w.option("maxRecordsPerFile", records_per_file).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a stream."""
    while first := archive.readline():
        assert first.startswith(b"WARC/"), first[:80]
        head = []
        while line := archive.readline().rstrip(b"\r\n"):
            head.append(line.decode())
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head)}
        yield fields, archive.read(int(fields["content-length"]))
        archive.read(len(END))


def _records(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    number = lambda urn: urn[len("<urn:record:") : -1] if urn and urn.startswith("<urn:record:") else None
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
    for b in batches:
        for content in b.column("content"):
            rows, size = [], 0
            for h, block in parse(gzip.open(io.BytesIO(content.as_buffer()))):
                body = block[block.index(b"\r\n\r\n") + 4 :]
                kind = h["warc-type"]
                if kind == "response" and (hashlib.sha256(body).hexdigest() != h["warc-payload-digest"][7:] or len(body) != int(h["x-payload-length"])):
                    raise ValueError(f"payload of {h.get('warc-record-id')} doesn't match its digest")
                rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"][7:], kind, number(h.get("warc-refers-to")), body if kind == "response" else None))
                size += len(body) + 500
                if size > most:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


_NAMES = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives; ids as text. A task holds one compressed file and some records of it, and checks each digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(resolve(table(spark, sf_dir, "pages")), path)
    r = read(spark, path)
    return r.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS o FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND o <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND o <> page_id THEN o END AS refers_to
FROM q
"""
