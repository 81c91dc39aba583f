"""Suffix-array dedup: removal of every byte that a repeated long string covers.

Which strings may repeat is settled first. Every window of the given length belongs to the least
hash among its 32-byte grams, so equal windows have equal anchors wherever they stand, and a run
of windows with one anchor is an item. Only items whose anchor comes up again, elsewhere or in
the item itself, are looked at.
Copies of an item's bytes count as one item with a multiplicity, before any bytes are shuffled.

The items of an anchor meet in one block, whose suffix array is built in two stages: suffixes
smaller than their successors are sorted directly, the others are induced from them by scanning
the buckets of first bytes in order. Neighbours that share the whole window length mark repeats.

An anchor with more than group_items different items (a passage inside very many documents) would
make one block too large. Its windows are compared by 128-bit hashes in a grouping with partial
sums, which is exact in the same way and needs no place where they all meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
GRAM = 32
#: Windows in an item at most; a longer run of one anchor is cut.
RUN = 1024
#: Different items of an anchor that one block takes at most, and the bytes after which a block is closed.
GROUP_ITEMS = 1500
BLOCK_BYTES = 1 << 19
#: Stands between the items of a block; no UTF-8 text has it.
SEPARATOR = b"\xff"


def _words_at(data: bytes) -> np.ndarray:
    """The 8 bytes at each position as a number; data has 8 bytes to spare."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def _gram_hashes(data: bytes) -> np.ndarray:
    words, n = _words_at(data), len(data) - GRAM + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        out += words[i : i + n] * np.uint64(factor)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, from the running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """Of every run of windows with one anchor: first and last window, anchor, and whether it holds the anchor twice."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), []
    hashes, width = _gram_hashes(data), length - GRAM + 1
    anchors = _sliding_least(hashes, width)
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    ends = np.r_[starts[1:], len(anchors)]
    if (ends - starts).max() > RUN:
        starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(starts, ends, strict=True)])
        ends = np.r_[starts[1:], len(anchors)]
    anchors = anchors[starts]
    again = [np.count_nonzero(hashes[a : b + width - 1] == h) > 1 for a, b, h in zip(starts.tolist(), ends.tolist(), anchors, strict=True)]
    return starts, ends - 1, anchors, again


def items(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (uid, first, last, anchor, again, print): the runs of docs (uid, text), and a hash of each one's bytes."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        row, first, last, anchor, twice, prints = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = (text or "").encode()
            a, b, h, again = runs(data, length)
            row.append(np.full(len(a), i))
            first.append(a)
            last.append(b)
            anchor.append(h)
            twice += again
            prints += [xxhash.xxh64_intdigest(data[x : y + length], 7) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return {
            "uid": batch.column(0).take(pa.array(np.concatenate(row))),
            "first": np.concatenate(first).astype(np.int32),
            "last": np.concatenate(last).astype(np.int32),
            "anchor": np.concatenate(anchor).view(np.int64),
            "again": pa.array(twice, pa.bool_()),
            "print": np.array(prints, np.uint64).view(np.int64),
        }

    schema = "uid binary, first int, last int, anchor long, again boolean, print long"
    return common.map_rows(docs.select("uid", "text"), schema, per_batch)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later; the end is smaller than any byte."""
    n = len(text)
    differs = np.r_[text[1:] != text[:-1], True]
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return (at + 1 < n) & (text[np.minimum(at + 1, n - 1)] > text)


def _sorted_directly(data: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the order of the depth bytes from each: by 16 bytes as numbers, then ties by all of them."""
    words = _words_at(data + bytes(24))
    high, low = words[starts].byteswap(), words[starts + 8].byteswap()
    order = np.lexsort((low, high))
    starts, high, low = starts[order], high[order], low[order]
    tied = np.r_[False, (high[1:] == high[:-1]) & (low[1:] == low[:-1])]
    tied |= np.r_[tied[1:], False]
    # Sorted by their 16 bytes, the ties are nearly in order, and each keeps to its group's places.
    places = np.flatnonzero(tied)
    among = starts[places]
    keys = [data[i : i + depth] for i in among.tolist()]
    starts[places] = among[sorted(range(len(keys)), key=keys.__getitem__)]
    return starts


def suffix_array(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of data, sorted by at least their first depth bytes."""
    text = np.frombuffer(data, np.uint8)
    small = smaller_than_next(text)
    # Stage one: the suffixes that are smaller than their successors, directly.
    direct = np.flatnonzero(small)
    direct = _sorted_directly(data, direct, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    # Stage two: scan the buckets of first bytes upwards. A suffix that is larger than its successor
    # comes into the bucket of its first byte in the order in which successors are met.
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([len(text) - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        bucket = [front]
        while len(front):
            before = front[front > 0] - 1
            front = before[text[before] == c]
            bucket.append(front)
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        order = np.concatenate(bucket)
        if not len(order):
            continue
        out.append(order)
        before = order[order > 0] - 1
        before = before[text[before] > c]
        if len(before):
            heads = text[before]
            sorted_before = before[np.argsort(heads, kind="stable")]
            cuts = np.searchsorted(text[sorted_before], np.unique(heads))
            for part in np.split(sorted_before, cuts[1:]):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each suffix in order but the first: the bytes it shares with the one before it, counted up to depth."""
    words = _words_at(data + bytes(depth + 8))
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(b), np.int64)
    open_ = np.arange(len(b))
    for offset in range(0, depth, 8):
        differ = words[a[open_] + offset] ^ words[b[open_] + offset]
        same = differ == 0
        least = differ & (~differ + np.uint64(1))
        shared[open_] += np.where(same, 8, np.bitwise_count(least - np.uint64(1)) // 8)
        open_ = open_[same]
        if not len(open_):
            break
    return np.minimum(shared, depth)


def repeated_windows(spans: list[bytes], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each span, which of its windows occurs elsewhere in the spans; all of them if the span has copies."""
    data = SEPARATOR.join(spans) + SEPARATOR
    starts = np.cumsum([0, *(len(s) + 1 for s in spans)])
    window = np.zeros(len(data), bool)
    for start, span in zip(starts, spans, strict=False):
        window[start : start + len(span) - length + 1] = True
    order = suffix_array(data, length)
    order = order[window[order]]
    repeated = np.zeros(len(data), bool)
    alike = common_prefixes(data, order, length) >= length
    repeated[order[1:][alike]] = True
    repeated[order[:-1][alike]] = True
    out = [repeated[a : a + len(s) - length + 1] for a, s in zip(starts, spans, strict=False)]
    return [np.ones_like(x) if n > 1 else x for x, n in zip(out, copies, strict=True)]


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edges[::2], edges[1::2] - 1


FOUND = "anchor long, print long, lows array<int>, highs array<int>"


def _found_batch(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2].astype(np.int32) for r in rows], ints),
            pa.array([r[3].astype(np.int32) for r in rows], ints),
        ],
        ["anchor", "print", "lows", "highs"],
    )


def _sort_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None

        def close() -> pa.RecordBatch:
            marks = repeated_windows([s for _, s in block.values()], [n for n, _ in block.values()], length)
            rows = [(*key, *_true_runs(m)) for key, m in zip(block, marks, strict=True) if m.any()]
            block.clear()
            return _found_batch(rows)

        for batch in batches:
            for anchor, print_, n, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size > BLOCK_BYTES:
                    yield close()
                    size = 0
                last = anchor
                block[anchor, print_] = n, span
                size += len(span)
        if block:
            yield close()

    return run


def _crowded(spans: DataFrame, length: int) -> DataFrame:
    """FOUND for items of crowded anchors: each window is hashed whole, hashes are counted."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        anchors, prints, offsets, highs, lows, copies = [], [], [], [], [], []
        for anchor, print_, n, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(len(span) - length + 1):
                digest = xxhash.xxh3_128_intdigest(span[i : i + length])
                highs.append(digest >> 64)
                lows.append(digest & 0xFFFFFFFFFFFFFFFF)
                offsets.append(i)
            count = len(offsets) - len(anchors)
            anchors += [anchor] * count
            prints += [print_] * count
            copies += [n] * count
        return {
            "anchor": np.array(anchors, np.int64),
            "print": np.array(prints, np.int64),
            "at": np.array(offsets, np.int32),
            "high": np.array(highs, np.uint64).view(np.int64),
            "low": np.array(lows, np.uint64).view(np.int64),
            "copies": np.array(copies, np.int64),
        }

    windows = common.map_rows(spans, "anchor long, print long, at int, high long, low long, copies long", per_batch)
    repeated = windows.groupBy("high", "low").agg(F.sum("copies").alias("n")).where("n > 1").select("high", "low")
    marked = windows.join(repeated, ["high", "low"]).groupBy("anchor", "print").agg(F.sort_array(F.collect_set("at")).alias("lows"))
    return marked.select("anchor", "print", "lows", F.col("lows").alias("highs"))


def repeats(docs: DataFrame, length: int = LENGTH, group_items: int = GROUP_ITEMS) -> DataFrame:
    """docs (uid, text, ...) with spans: the byte ranges (low, high) that windows repeated anywhere cover, or null.

    Rows that share a uid repeat each other. A null or short text has no windows.
    """
    spark = docs.sparkSession
    shards = common.partitions(spark)
    found = common.stored(items(docs, length))
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again")
    shared = found.drop("again").join(counts.select("anchor"), "anchor")
    different = shared.groupBy("anchor", "print").agg(
        F.count("*").alias("copies"), F.min(F.struct("uid", "first", "last")).alias("one")
    )
    crowd = different.groupBy("anchor").agg((F.count("*") > group_items).alias("crowded"))
    wanted = different.join(crowd, "anchor").select(
        F.col("one.uid").alias("uid"), F.struct("anchor", "print", "copies", "crowded", "one.first", "one.last").alias("item")
    )
    by_text = wanted.groupBy("uid").agg(F.collect_list("item").alias("items"))

    def slices(batch: pa.RecordBatch) -> dict:
        rows = []
        for text, wants in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
            data = text.encode()
            rows += [(w["anchor"], w["print"], w["copies"], data[w["first"] : w["last"] + length], w["crowded"]) for w in wants]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        names = ("anchor", "print", "copies", "span", "crowded")
        return {k: pa.array(list(c), kind) for k, c, kind in zip(names, columns, kinds, strict=True)}

    # All columns go along, so that both joins with the texts read one shuffle of them.
    spans = common.map_rows(
        docs.join(by_text, "uid"),
        "anchor long, print long, copies long, span binary, crowded boolean",
        slices,
    )
    dealt = spans.where("not crowded").drop("crowded").repartition(shards, "anchor").sortWithinPartitions("anchor")
    sorted_ = dealt.mapInArrow(_sort_blocks(length), FOUND)
    crowded = _crowded(spans.where("crowded").drop("crowded").dropDuplicates(["anchor", "print"]), length)
    marks = shared.join(sorted_.union(crowded), ["anchor", "print"])
    low = F.transform("lows", lambda x: x + F.col("first"))
    high = F.transform("highs", lambda x: x + F.col("first") + length)
    ranges = marks.select("uid", F.explode(F.arrays_zip(low.alias("low"), high.alias("high"))).alias("range"))
    return docs.join(ranges.groupBy("uid").agg(F.collect_set("range").alias("spans")), "uid", "left")


def with_uid(docs: DataFrame) -> DataFrame:
    """docs with uid, a digest of doc_id and text: rows of one uid are repeats of one row."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), common.text_or_empty())))
    return docs.withColumn("uid", F.coalesce(digest, F.lit(b"")))


def kept(data: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    if not ranges:
        return 0, 0, data
    removed = runs_ = at = 0
    parts = []
    for r in sorted(ranges, key=lambda r: r["low"]):
        if r["low"] > at or not runs_:
            parts.append(data[at : r["low"]])
            runs_ += 1
            at = r["low"]
        if r["high"] > at:
            removed += r["high"] - at
            at = r["high"]
    parts.append(data[at:])
    return removed, runs_, b"".join(parts)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame, length: int = LENGTH, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A row for each row of docs (doc_id, text) with what is removed. A null text counts as empty."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        left = [kept(t, r) for t, r in zip(texts, batch.column(2).to_pylist(), strict=True)]
        return {
            "doc_id": batch.column(0),
            "n_bytes": np.array([len(t) for t in texts]),
            "n_removed": np.array([x for x, _, _ in left]),
            "n_spans": np.array([x for _, x, _ in left]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, _, x in left], pa.string()),
        }

    found = repeats(with_uid(docs.select("doc_id", "text")), length, group_items)
    return common.map_rows(found.select("doc_id", "text", "spans"), REMOVED, per_batch)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document; a null text is empty, rows of equal doc_id and text repeat each other."""
    return removed(common.documents(spark, sf_dir))
