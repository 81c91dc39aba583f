"""Exact dedup with a cuckoo-filter index over text digests.

Each task keeps a cuckoo filter of the digests that are live in it. A filter hit is verified
against the full digests stored in the same bucket; a key that finds no slot makes the index
grow and be filled again from its stored keys. A live digest whose document is superseded by a
larger doc_id is deleted and inserted anew with its successor.

The index runs twice: over each input partition, where a group of copies shrinks to one row a
task, and over digest shards, which see one row a task and digest. So a group that holds a third
of all rows is never gathered anywhere. A last join gives each document its group; it is left to
adaptive execution, which splits a skewed digest.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket, with the full keys beside them."""

    def __init__(self, buckets: int = 1024):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingerprints = array("H", bytes(2 * SLOTS * buckets))
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)
        self.size = 0

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int]:
        low, fingerprint = struct.unpack_from("<QH", key)
        return low, fingerprint or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """The slot that holds key, or -1: the filter is asked first, the bucket's keys confirm."""
        low, fingerprint = self._parts(key)
        bucket = low & self.mask
        for b in (bucket, self._other(bucket, fingerprint)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.fingerprints[slot] == fingerprint and self.keys[slot] == key:
                    return slot
        return -1

    def _place(self, bucket: int, fingerprint: int, key: bytes, value) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.fingerprints[slot]:
                self.fingerprints[slot], self.keys[slot], self.values[slot] = fingerprint, key, value
                return True
        return False

    def insert(self, key: bytes, value) -> None:
        low, fingerprint = self._parts(key)
        bucket = low & self.mask
        self.size += 1
        if self._place(bucket, fingerprint, key, value):
            return
        bucket = self._other(bucket, fingerprint)
        for kick in range(MAX_KICKS):
            if self._place(bucket, fingerprint, key, value):
                return
            slot = bucket * SLOTS + kick % SLOTS
            evicted = self.fingerprints[slot], self.keys[slot], self.values[slot]
            self.fingerprints[slot], self.keys[slot], self.values[slot] = fingerprint, key, value
            fingerprint, key, value = evicted
            bucket = self._other(bucket, fingerprint)
        self._grow(key, value)

    def _grow(self, key: bytes, value) -> None:
        stored = [*self.items(), (key, value)]
        self._clear(2 * (self.mask + 1))
        for k, v in stored:
            self.insert(k, v)

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.fingerprints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


CLASS_SCHEMA = "digest binary, keep_id long, top_rows long, group_size long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, top_rows, group_size), many a digest, to one row a digest."""
    index = CuckooIndex()
    for batch in batches:
        for key, new, top, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slot = index.find(key)
            if slot < 0:
                index.insert(key, (new, top, n))
                continue
            live, live_top, live_n = index.values[slot]
            if new is not None and (live is None or new > live):
                index.delete(key)
                index.insert(key, (new, top, n + live_n))
            else:
                index.values[slot] = (live, live_top + (top if new == live else 0), n + live_n)
    rows = list(index.items())
    for start in range(0, len(rows), 50_000):
        part = rows[start : start + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in part], pa.binary()),
                *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(3)),
            ],
            ["digest", "keep_id", "top_rows", "group_size"],
        )


def classes(keyed: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a digest of keyed (digest binary, doc_id long): the largest doc_id, rows that have it, rows in all."""
    spark = keyed.sparkSession
    one = F.lit(1).cast("long")
    rows = keyed.select("digest", F.col("doc_id").alias("keep_id"), one.alias("top_rows"), one.alias("group_size"))
    partial = rows.mapInArrow(_fold, CLASS_SCHEMA)
    return partial.repartition(shards or common.partitions(spark), "digest").mapInArrow(_fold, CLASS_SCHEMA)


def with_classes(keyed: DataFrame, shards: int | None = None) -> DataFrame:
    """keyed (digest binary, doc_id long, ...) with keep_id, group_size and top_rows.

    No operator above this join needs a digest's rows together, so a skewed digest can be split.
    """
    return keyed.join(classes(keyed.select("digest", "doc_id"), shards), "digest", "left")


def first_of_repeats(joined: DataFrame) -> DataFrame:
    """joined with kept: the row that has keep_id, and of several such rows one."""
    apart = joined.repartition("digest", "doc_id")
    order = Window.partitionBy("digest", "doc_id").orderBy("top_rows")
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return apart.withColumn("kept", mine & (F.row_number().over(order) == 1))


def exact_dedup(hashed: DataFrame, shards: int | None = None) -> DataFrame:
    """A row for each row of hashed (doc_id, text_sha256): its group's keep_id and size, and whether it stays.

    A null text is hashed as the empty text by the caller. A null doc_id is smaller than any other.
    Of rows that share text and largest doc_id, one stays. An empty table gives no rows.
    """
    keyed = hashed.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex("text_sha256").alias("digest"))
    return first_of_repeats(with_classes(keyed, shards)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all its columns, whatever their names."""
    digest = F.unhex(F.sha2(common.text_or_empty(), 256))
    keyed = docs.select(
        F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest")
    )
    top = with_classes(keyed, shards).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return first_of_repeats(top).where("kept").select("__row.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equals; a null text equals an empty one."""
    digest = F.sha2(common.text_or_empty(), 256)
    return exact_dedup(common.documents(spark, sf_dir).select("doc_id", digest.alias("text_sha256")))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
