"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash space, so its size
follows the document's and the sketch of a union is the union of the sketches. The share of one
sketch that lies in another estimates containment, however unequal the documents are. The
smallest hash is always kept, so that a document with few shingles has a sketch too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import shingle_hashes

WIDTH = 5
#: One in so many of all hashes is kept.
SCALE = 4


def sketch(text: str | None, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles that are below 2**64 / scale, and the least; none without words."""
    hashes = shingle_hashes(common.words_of(text), width)
    if not len(hashes):
        return hashes
    return np.unique(np.r_[hashes[hashes < np.uint64((1 << 64) // scale)], hashes.min()])


def merged(sketches: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of all shingles of several texts: their hashes below the threshold, and the least."""
    hashes = np.unique(np.concatenate(sketches)) if sketches else np.empty(0, np.uint64)
    return hashes[(hashes < np.uint64((1 << 64) // scale)) | (np.arange(len(hashes)) == 0)]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if both have none, 0 if only a has none."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def printed(hashes: np.ndarray) -> str:
    """All hashes, 16 hexadecimal digits each."""
    return hashes.astype(">u8").tobytes().hex()


def sketches(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Rows (doc_id, hashes array<long>) of docs; the hashes are unsigned bits. Null text: an empty array."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = [sketch(t, width, scale).view(np.int64) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "hashes": pa.array(found, pa.list_(pa.int64()))}

    return common.map_rows(docs.select("doc_id", "text"), "doc_id long, hashes array<long>", per_batch)


def _falling_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 doc_ids, largest first, that cut docs into ranges of about equal counts."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = docs.agg(F.percentile_approx("doc_id", shares)).first()[0]
    return sorted(set(found or []), reverse=True)


def _range_of(bounds: list[int]) -> Column:
    """How many bounds exceed doc_id, found in two levels; all of them for a null doc_id."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    above = lambda xs: F.size(F.filter(xs, lambda x: x > F.col("doc_id")))
    row = above(longs([r[0] for r in rows]))
    inside = above(F.element_at(F.array(*map(longs, rows)), F.greatest(row, F.lit(1))))
    return F.when(F.col("doc_id").isNull(), len(bounds)).when(row == 0, 0).otherwise((row - 1) * step + inside)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) in ranges of falling doc_id, one a partition, sorted, each followed by the next range's first row.

    Column ghost marks those copies. Only ids of the ranges' first rows pass the driver, one a
    partition. The texts are shuffled once.
    """
    parts = parts or common.partitions(docs.sparkSession)
    placed = docs.withColumn("part", _range_of(_falling_bounds(docs, parts)).cast("int"))
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # The range before each range gets a copy of its first row; the last one gets the very first row.
    rows = [(part, heads[part], order[i - 1]) for i, part in enumerate(order)]
    table = docs.sparkSession.createDataFrame(rows, "of int, head long, before int")
    here = F.struct(F.col("part").alias("to"), F.lit(False).alias("ghost"))
    there = F.struct(F.col("before").alias("to"), F.lit(True).alias("ghost"))
    dealt = (
        placed.join(F.broadcast(table), F.col("part") == F.col("of"))
        .withColumn("put", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, there)).otherwise(F.array(here))))
        .select("doc_id", "text", "put.ghost", F.col("put.to").alias("to"))
    )
    return dealt.repartitionById(parts, "to").sortWithinPartitions("ghost", F.col("doc_id").desc_nulls_last(), "text").drop("to")


def edited(text: str, following: str) -> str:
    """text with its last third of code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


EDIT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    held, rows = None, []

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for doc_id, text, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ghost and held is None:  # a second row with the first row's doc_id
                continue
            text = text or ""
            own = sketch(text)
            if held is not None:
                held_id, held_text, held_sketch = held
                other = edited(held_text, text)
                other_sketch = sketch(other)
                rows.append(
                    (
                        held_id,
                        len(held_text),
                        hashlib.sha256(other.encode()).hexdigest(),
                        printed(held_sketch),
                        printed(other_sketch),
                        containment(held_sketch, other_sketch),
                        containment(held_sketch, own),
                    )
                )
            held = None if ghost else (doc_id, text, own)
        if len(rows) >= 500:
            yield flush()
    if rows:
        yield flush()


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls count as empty text; rows with equal doc_id follow each other by text, null doc_ids come last."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return with_next(docs).mapInArrow(_edits, EDIT_SCHEMA)
