"""A content-addressed archive of web records.

Payloads are stored once, under their SHA-256, as gzip members; whoever stores a second payload under the same digest
compares the bytes. Header blocks are stored apart, exactly as they were, one row a record. A join on the digest gives
the original records back, byte by byte, and each payload is hashed again when it is read.

Copies of a payload meet early: a task passes on the first of each digest it sees, so a payload that a third of all
records share is shuffled once a task, and the join that gives it back to its records has one such row on one side.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records with the same payload of at least so many bytes refer to one of them.
REVISIT_BYTES = 100
#: Sizes of the files that `write_files` aims at; a file is read by one task.
FILE_BYTES = 16 << 20
GZIP_LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = b"\r\n\r\n"


# ---------------------------------------------------------------------------------------------------------- from pages


def decided(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as (record, page_id, url, digest, payload_bytes, original).

    original is the record number and page_id that a revisit refers to, null for a response. Of equal payloads of at
    least that many bytes the one with the smallest page_id is the response, a null page_id after all others, and of
    several such rows the first read. A null html is an empty payload. Other columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = common.stored(
        pages.select(
            F.monotonically_increasing_id().alias("record"),
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.sha2(html, 256).alias("digest"),
            F.octet_length(html).cast("long").alias("payload_bytes"),
        )
    )
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record")).alias("first")
    shared = (
        keyed.where(F.col("payload_bytes") >= least)
        .groupBy("digest")
        .agg(first, F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first.page_id", "first.record")
        .toDF("digest", "first_page", "first_record")
    )
    original = F.when(
        F.col("first_record") != F.col("record"),
        F.struct(F.col("first_record").alias("record"), F.col("first_page").alias("page_id")),
    )
    return keyed.join(shared, "digest", "left").select(
        "record", "page_id", "url", "digest", "payload_bytes", original.alias("original")
    )


def record_id(page_id: Column, record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), record, F.lit(">"))


def header_block(date: str = DATE) -> Column:
    """What precedes the payload of a row of `decided`: WARC header and, after an empty line, the HTTP header.

    Bytes of an address that no header line can hold are percent-encoded; without an address the line is left out.
    """
    safe = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    revisit = F.col("original").isNotNull()
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("record"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("original.page_id"), F.col("original.record")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)


# ------------------------------------------------------------------------------------------------------------- archive


def pack(payload: bytes) -> bytes:
    """A gzip member that is the same for the same payload."""
    return gzip.compress(payload, GZIP_LEVEL, mtime=0)


CONTENT_ARROW = pa.schema([("digest", pa.binary()), ("member", pa.binary())])


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(payload) to (digest, member): the first of each digest in the partition.

    The others must have the same length and the same digest by another function.
    """
    seen: dict[bytes, tuple[int, bytes]] = {}
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            content = payload or b""
            digest = hashlib.sha256(content).digest()
            other = len(content), hashlib.blake2b(content, digest_size=16).digest()
            known = seen.setdefault(digest, other)
            if known is other:
                yield pa.RecordBatch.from_pylist([{"digest": digest, "member": pack(content)}], schema=CONTENT_ARROW)
            elif known != other:
                raise ValueError(f"two payloads under digest {digest.hex()}")


def _first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest to the first of each; the others must be equal to it."""
    digest, member = None, None
    for batch in batches:
        fresh = []
        for row, (key, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != digest:
                digest, member = key, value
                fresh.append(row)
            elif value != member and gzip.decompress(value) != gzip.decompress(member):
                raise ValueError(f"two payloads under digest {key.hex()}")
        yield batch.take(pa.array(fresh, pa.int64()))


def contents(payloads: DataFrame) -> DataFrame:
    """payloads (payload binary, null for empty) as (digest, member), each different one once."""
    spark = payloads.sparkSession
    early = payloads.select("payload").mapInArrow(_first_seen, "digest binary, member binary")
    dealt = early.repartition(common.partitions(spark), "digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(_first_of_run, "digest binary, member binary")


@dataclass
class Archive:
    """headers (record, header, digest, own) and contents (digest, member), both stored.

    own tells whether the record carries its payload or only refers to it by digest.
    """

    headers: DataFrame
    contents: DataFrame


def archive(headers: DataFrame, payloads: DataFrame) -> Archive:
    """Stores headers (record long, header binary, digest binary, own boolean) and the different payloads (payload)."""
    return Archive(common.stored(headers.select("record", "header", "digest", "own")), common.stored(contents(payloads)))


RECORD_SCHEMA = "record long, header binary, payload binary, digest binary, own boolean"


def reconstruct(stored: Archive) -> DataFrame:
    """Every record with its exact header block and its full payload, revisits included.

    A payload that is missing or whose bytes do not hash to its digest is an error. `record_bytes` joins the parts.
    """
    return stored.headers.join(stored.contents, "digest", "left").select(
        "record", "header", "member", "digest", "own"
    ).mapInArrow(_unpacked, RECORD_SCHEMA)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        record, header, members, digests, own = batch.columns
        payloads = []
        for member, digest in zip(members.to_pylist(), digests.to_pylist(), strict=True):
            payload = None if member is None else gzip.decompress(member)
            if payload is None or hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"the archive has no sound payload of digest {digest.hex()}")
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays(
            [record, header, pa.array(payloads, pa.binary()), digests, own],
            ["record", "header", "payload", "digest", "own"],
        )


def record_bytes() -> Column:
    """A record as it stands in a file, up to the two line ends that close it."""
    return F.concat("header", F.when(F.col("own"), F.col("payload")).otherwise(F.lit(b"")))


def archive_of_pages(pages: DataFrame, least: int = REVISIT_BYTES, date: str = DATE) -> Archive:
    """One record for each of pages (page_id, url, html); see `decided`."""
    headers = decided(pages, least).select(
        "record",
        header_block(date).cast("binary").alias("header"),
        F.unhex("digest").alias("digest"),
        F.col("original").isNull().alias("own"),
    )
    return archive(headers, pages.select(F.col("html").cast("binary").alias("payload")))


# --------------------------------------------------------------------------------------------------------------- files


def write_files(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """records (header, payload, own) as WARC files of about file_bytes each, in whatever store path names.

    Spark's text writer puts the closing line ends between records, and its commit keeps files of failed tasks out.
    """
    whole = records.select(record_bytes().alias("record"))
    total = whole.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    lines = whole.repartition(1 + total // file_bytes).select(F.col("record").cast("string"))
    lines.write.option("lineSep", END.decode()).text(path)


READ_SCHEMA = "file string, start long, header binary, payload binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: file, start, exact header block and payload.

    The header block of an HTTP record ends with the HTTP header. Lengths come from Content-Length, so a payload may hold
    anything. A file that ends inside a record is an error that names the file and the place.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, READ_SCHEMA)


READ_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = _gunzipped(content) if content[:2] == b"\x1f\x8b" else content
            for start, header, payload in parse(data, file):
                row = {"file": file, "start": start, "header": header, "payload": payload}
                yield pa.RecordBatch.from_pylist([row], schema=READ_ARROW)


def _gunzipped(content: bytes) -> bytes:
    """All gzip members of a file."""
    out = []
    while content:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse(data: bytes, file: str = "") -> Iterator[tuple[int, bytes, bytes]]:
    """(start, header block, payload) of each record."""
    at = 0
    while at < len(data):
        named = data.find(END, at)
        sizes = re.findall(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", data[at : max(named, at)])
        body = named + len(END)
        if named < 0 or not data.startswith(b"WARC/", at) or not sizes or body + int(sizes[0]) > len(data):
            raise ValueError(f"no whole record at byte {at} of {file}")
        end = body + int(sizes[0])
        if re.search(rb"(?im)^content-type:[ \t]*application/http", data[at:named]):
            inner = data.find(END, body, end)
            body = inner + len(END) if inner >= 0 else end
        yield at, data[at:body], data[body:end]
        at = end + len(END)


def fields(header: bytes) -> dict[str, str]:
    """Named fields of a WARC header, names in lower case; the HTTP header after it is left out."""
    lines = header.split(END, 1)[0].decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


# --------------------------------------------------------------------------------------------------------------- query

PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page_of(urn: str | None) -> int | None:
    """The page_id in a record id of this module."""
    page = urn.split(":")[2] if urn else ""
    return int(page) if page else None


def described(records: DataFrame) -> DataFrame:
    """What the headers and payloads of records made by `archive_of_pages` say, one row a record."""

    def describe(batch: pa.RecordBatch) -> dict:
        headers = [fields(h) for h in batch.column(0).to_pylist()]
        payloads = batch.column(1).to_pylist()
        return {
            "page_id": pa.array([page_of(h["warc-record-id"]) for h in headers], pa.int64()),
            "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
            "payload_digest": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
            "record_type": pa.array([h["warc-type"] for h in headers], pa.string()),
            "refers_to": pa.array([page_of(h.get("warc-refers-to")) for h in headers], pa.int64()),
        }

    return common.map_rows(records.select("header", "payload"), PAGE_SCHEMA, describe)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, archived and read back."""
    return described(reconstruct(archive_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
           min(page_id) OVER (PARTITION BY html) AS least
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND least < page_id THEN least END AS refers_to
FROM s
"""
