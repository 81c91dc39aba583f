"""Archives against plain counting, and round trips byte by byte."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "<p>one payload that many pages share é</p>" * 5
PAGES = [
    (9, "http://a/9", LONG),
    (3, "http://a/3", LONG),
    (5, "http://a/5\r\nX: 1", LONG),
    (5, "http://a/5 b", LONG),
    (3, "http://a/3", LONG),
    (None, None, LONG),
    (1, "http://a/1", "short"),
    (2, "http://a/2", "short"),
    (4, None, None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "x" * 100),
    (8, "http://a/8", "x" * 100),
    (10, "http://a/10", "y" * 99),
    (11, "http://a/11", "y" * 99),
    (12, "http://a/12", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9 + "\x00 end"),
    (13, "http://a/13", "<html>" + "long ü " * 400_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def slow(rows):
    first = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 100 and page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    out, answered = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        content = (html or "").encode()
        revisit = len(content) >= 100 and html in answered
        answered.add(html)
        kind = "revisit" if revisit else "response"
        refers = first.get(html) if revisit else None
        out.append((page_id, len(content), hashlib.sha256(content).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def described(spark, rows):
    stored = warc.archive_of_pages(pages(spark, rows))
    return sorted((tuple(r) for r in warc.described(warc.reconstruct(stored)).collect()), key=repr)


def test_records_and_revisits(spark):
    assert described(spark, PAGES) == slow(PAGES)


def test_no_pages_and_null_ids(spark):
    assert described(spark, []) == []
    rows = [(None, None, LONG), (None, "u", LONG)]
    assert [r[3:] for r in described(spark, rows)] == [("response", None), ("revisit", None)]


def test_clashing_columns(spark):
    clash = pages(spark).selectExpr("*", *(f"'x' as {c}" for c in "digest record header payload own member original".split()))
    got = warc.described(warc.reconstruct(warc.archive_of_pages(clash))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow(PAGES)


def test_payloads_are_stored_once(spark):
    stored = warc.archive_of_pages(pages(spark))
    rows = stored.contents.collect()
    assert len(rows) == len({h or "" for _, _, h in PAGES}) == len({bytes(r.digest) for r in rows})
    assert all(hashlib.sha256(gzip.decompress(r.member)).digest() == r.digest for r in rows)


def test_files_round_trip(spark, tmp_path):
    records = warc.reconstruct(warc.archive_of_pages(pages(spark)))
    path = str(tmp_path / "files")
    warc.write_files(records, path, file_bytes=1000)
    read = warc.read_files(spark, path)
    expected = sorted((bytes(r.header), bytes(r.payload) if r.own else b"") for r in records.collect())
    assert sorted((bytes(r.header), bytes(r.payload)) for r in read.collect()) == expected
    # Records that come from files go through an archive as they are, headers of any kind included.
    numbered = read.withColumn("record", F.monotonically_increasing_id()).withColumn("own", F.lit(True))
    headers = numbered.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    again = warc.reconstruct(warc.archive(headers, read)).select(warc.record_bytes().alias("b")).collect()
    assert sorted(bytes(r.b) for r in again) == sorted(h + p for h, p in expected)


def test_parses_foreign_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length: 5\r\nX: y\r\n\r\nhello\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    body = b"\xff\xfe\r\n\r\nWARC/1.0 no record"
    head = b"WARC/1.0\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http + body)
    (tmp_path / "plain.warc").write_bytes(info + head + http + body + b"\r\n\r\n")
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(head + http + body + b"\r\n\r\n"))
    rows = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted((bytes(r.header), bytes(r.payload)) for r in rows) == sorted([(info[:-9], b"hello"), (head + http, body)] * 2)
    assert list(warc.parse(b"")) == []
    for broken in (info[:-6], b"junk\r\n\r\n", b"WARC/1.0\r\n\r\n"):
        with pytest.raises(ValueError, match="no whole record at byte 0"):
            list(warc.parse(broken))


def test_damage_is_an_error(spark):
    stored = warc.archive_of_pages(pages(spark))
    other = F.lit(warc.pack(b"other"))
    for contents in (stored.contents.where("false"), stored.contents.withColumn("member", other)):
        with pytest.raises(Exception, match="no sound payload"):
            warc.reconstruct(warc.Archive(stored.headers, contents)).collect()
    two = spark.createDataFrame([(b"k", warc.pack(b"a")), (b"k", warc.pack(b"b"))], "digest binary, member binary")
    with pytest.raises(Exception, match="two payloads"):
        two.coalesce(1).mapInArrow(warc._first_of_run, two.schema).collect()
