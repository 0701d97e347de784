"""WARC archives: write captures of pages, read them back, assemble transactions.

Each capture has a request, a response (or a revisit of an equal payload) and a
metadata record; request and metadata point at the response by
``WARC-Concurrent-To``.  Archives are written by Spark's text sink (record after
record, each ended by two line breaks), so any store Spark writes to will do.

Inputs and cases: a null html is an empty payload; equal payloads, empty ones
included, have one response, that of the largest page id; rows that repeat page
id and payload are one capture; one page id with different payloads gives one
capture each; a null page id is written as an empty id and never wins over
another; line breaks, header-like lines and record ends inside a payload do no
harm, as records are cut by their content length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantmill.functions.text import fence

from .common import stored

END = "\r\n\r\n"
#: Records per archive: bounds what one reader task holds.
RECORDS_PER_FILE = 3000
#: Ways in which the revisits of one response are spread.
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 32 digits of five bits, no padding."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digits = [
        F.substring(F.lit(DIGITS), F.shiftright(g, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        for g in groups for k in range(4)
    ]
    return F.concat(*digits)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without its final line breaks; fields with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzip archives under ``path``.

    Which capture is the response of its payload is settled on narrow rows
    (digest, page id), for payloads that occur more than once; pages are joined
    to the outcome by digest, and a digest that fills many rows is split by the
    skew join.
    """
    plain = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), F.col("page_id").cast("long").alias("id"),
        # header values must stay on one line
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]+", " ").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    first = plain.groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = plain.join(first, "digest", "left").withColumn("fresh", F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("top")))
    # digests that several records name are worked out once
    capture_id = _uuid(F.lit("capture"), "page", "digest")
    joined = joined.select("*", fence(capture_id).alias("capture"))
    fresh = F.col("fresh")
    capture = F.col("capture")
    origin = F.when(~fresh, _uuid(F.lit("capture"), F.coalesce(F.col("top").cast("string"), F.lit("")), "digest"))
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("-"))
    target = ("WARC-Target-URI", F.col("url"))
    request = _record(
        F.lit("request"), _uuid(F.lit("request"), "page", "digest"),
        [target, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    response = _record(
        F.when(fresh, F.lit("response")).otherwise(F.lit("revisit")), capture,
        [target, ("WARC-Refers-To", origin), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(~fresh, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END),
                 F.when(fresh, F.col("html")).otherwise(F.lit(""))),
    )
    metadata = _record(
        F.lit("metadata"), _uuid(F.lit("metadata"), "page", "digest"),
        [target, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")),
    )
    (
        joined.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
        .mode("append").text(path)
    )


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, cut by content length."""
    at, size = 0, len(data)
    while at < size:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        at = stop
        while data[at : at + 2] == b"\r\n":
            at += 2


RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_bytes bigint, payload_digest string, declared_digest string, page_id bigint, block binary"
)


def read_records(spark: SparkSession, path: str, keep_block: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``payload_bytes`` and ``payload_digest`` are computed from the payload that
    was read (responses only); ``block`` is null unless ``keep_block``.  Copies
    of a record (equal record id) count once.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
        ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("declared_digest", pa.string()), ("page_id", pa.int64()), ("block", pa.binary()),
    ])

    def row(fields: dict[str, str], block: bytes) -> dict:
        kind = fields["WARC-Type"]
        out = {
            "record_id": fields["WARC-Record-ID"], "record_type": kind, "concurrent_to": fields.get("WARC-Concurrent-To"),
            "refers_to": fields.get("WARC-Refers-To"), "target_uri": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date"),
            "declared_digest": (fields.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None,
            "block": block if keep_block else None,
        }
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            out["payload_bytes"] = len(payload)
            out["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if kind == "metadata":
            value = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x).get("page-id", "")
            out["page_id"] = int(value) if value else None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, rows, held = content.as_py(), [], 0
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for fields, block in records(data):
                    rows.append(row(fields, block))
                    held += len(block) if keep_block else 0
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    read = found.mapInArrow(run, RECORD).dropDuplicates(["record_id"])
    # several joins read the records: archives are unpacked once
    return read if keep_block else stored(read, "warc-records")


def transactions(read: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, page_id, response, request, metadata``.

    Request and metadata find their response by the concurrent-to identifier.
    """
    fields = [F.struct(*[c for c in read.columns if c not in ("concurrent_to", "page_id")]).alias("r")]
    captures = read.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), *fields)
    sides = {}
    for kind in ("request", "metadata"):
        sides[kind] = read.where(F.col("record_type") == kind).select(
            F.col("concurrent_to").alias("capture_id"), F.col("record_id").alias(kind + "_id"), "page_id", "target_uri")
    request = sides["request"].select("capture_id", F.struct("request_id", "target_uri").alias("request"))
    metadata = sides["metadata"].select("capture_id", "page_id", F.struct("metadata_id", "page_id").alias("metadata"))
    return captures.join(request, "capture_id", "left").join(metadata, "capture_id", "left").select(
        "capture_id", "page_id", F.col("r").alias("response"), "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Per capture the full payload's size and digest; revisits take them from the response they refer to.

    A response that a third of all captures refer to is looked up under several
    salts, so its revisits are spread.
    """
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(SALTS))
    asked = captures.where("response.refers_to IS NOT NULL").select(F.col("response.refers_to").alias("capture_id")).distinct()
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    origin = captures.where("response.record_type = 'response'").join(asked, "capture_id", "left_semi").select(
        salts.alias("salt"),
        F.col("capture_id").alias("origin_id"), F.col("page_id").alias("origin_page"),
        F.col("response.payload_bytes").alias("origin_bytes"), F.col("response.payload_digest").alias("origin_digest"))
    own = F.col("response.record_type") == "response"
    met = (F.col("c.response.refers_to") == F.col("o.origin_id")) & (F.col("c.salt") == F.col("o.salt"))
    return captures.withColumn("salt", salt).alias("c").join(origin.alias("o"), met, "left").select(
        "page_id", F.coalesce("response.payload_bytes", "origin_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "origin_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(~own, F.col("origin_page")).alias("refers_to"), "capture_id",
        F.col("request.request_id").alias("request_id"), F.col("metadata.metadata_id").alias("metadata_id"),
    )
