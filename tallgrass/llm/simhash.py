"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most 4 bits are found without pairing all of them. The 64 bits
are cut into three segments, so in at least one of them two such fingerprints differ by one bit
at most. Each segment is indexed whole and once with each of its bits masked out; fingerprints
that meet under a key are verified on all 64 bits. Equal fingerprints are one node from the
start, so copies never pair up. In a large bucket, neighbours are found by a search that drops
every fingerprint it has reached, which emits a spanning forest in place of all pairs.

Four of 64 bits is a narrow radius: texts that share 0.8 of their shingles differ in about 10 bits
of 64. near_duplicates therefore takes fingerprints of 512 bits. They are indexed by bands, samples
of all their bits that grow longer and more with the corpus; whatever shares a band is compared on
all bits, and what may be near is decided by the shingles themselves.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.graph import star_components
from . import common

SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
SEED = 42
#: The similarity (shared shingles of all) from which texts are near duplicates.
SIMILAR = 0.8
#: At a similarity of 0.8 about 0.152 of the bits differ: 78 of 512, with a deviation of 8. Pairs up to
#: WIDE_BITS are decided by their shingles; up to SURE_BITS a forest of a band's pairs is tried first.
WIDE_WORDS, WIDE_BITS, SURE_BITS = 8, 112, 44
#: A pair that differs in BAND_BITS shares a band but for BAND_MISS; about BAND_SIZE fingerprints share one by chance.
BAND_BITS, BAND_MISS, BAND_SIZE = 92, 0.01, 2048
#: Buckets up to this size are compared by shifts of whole arrays, larger ones by a search.
SMALL_BUCKET = 8


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all runs of width words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits).view(">u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int, carry: str = "doc_id", words: int = 1) -> DataFrame:
    """Rows (carry, fp long, wide array<long>) of docs; a null or empty text has fingerprint zero.

    wide has all words of 64 bits, fp is the first. Further words come from rehashed shingles.
    """

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(common.words_of(text), width)
            if words > 1:  # a similarity is one of sets
                hashes = np.unique(hashes)
            row = [majority(hashes)]
            for _ in range(words - 1):
                hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes ^= hashes >> np.uint64(32)
                row.append(majority(hashes))
            found.append(row)
        table = np.array(found, np.uint64).view(np.int64)
        offsets = pa.array(np.arange(0, table.size + 1, words, dtype=np.int32))
        return {carry: batch.column(0), "fp": table[:, 0].copy(), "wide": pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))}

    schema = StructType([docs.schema[carry], StructField("fp", LongType()), StructField("wide", ArrayType(LongType()))])
    return common.map_rows(docs.select(carry, "text"), schema, per_batch)


def signature_keys(prints: DataFrame, words: range = range(1)) -> DataFrame:
    """Rows (key, fp, and root if prints has it) for all keys of some words of column wide.

    A key holds the number of the segment, the masked bit (0: none), and the segment's other bits.
    """
    lists = [F.array(*[F.lit(s[i]) for s in SEGMENTS]) for i in (0, 1)]
    segments = F.explode(F.sequence(F.lit(3 * words.start), F.lit(3 * words.stop - 1))).alias("segment")
    own = [c for c in ("fp", "root") if c in prints.columns]
    start, length = (F.element_at(x, (F.col("segment") % 3 + 1).cast("int")) for x in lists)
    word = F.element_at("wide", (F.floor(F.col("segment") / 3) + 1).cast("int"))
    taken = F.call_function("shiftrightunsigned", word, start).bitwiseAND(F.expr("shiftleft(1L, length) - 1"))
    cut = prints.select(*own, "wide", segments).withColumn("length", length).withColumn("bits", taken)
    variants = cut.select(*own, "segment", "bits", F.explode(F.sequence(F.lit(0), "length")).alias("masked"))
    rest = F.when(F.col("masked") == 0, F.col("bits")).otherwise(F.expr("bits & ~shiftleft(1L, masked - 1)"))
    place = F.expr("shiftleft(cast(segment * 32 + masked as long), 24)")
    return variants.select(place.bitwiseOR(rest).alias("key"), *own)


def _near(values: np.ndarray, other: np.ndarray | int, bits: int) -> np.ndarray:
    return np.bitwise_count(values ^ other) <= bits


def _forest(bucket: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a bucket. What has been reached is not compared again.

    The search goes breadth first from the bucket's first fingerprint, so buckets that share most of
    their members choose the same links, which become one.
    """
    links, rest, front = [], bucket[1:], deque(bucket[:1])
    while len(rest):
        if not front:
            front, rest = deque(rest[:1]), rest[1:]
            continue
        one = front.popleft()
        near = _near(rest, one, bits)
        if near.any():
            links += [(one, x) for x in rest[near]]
            front.extend(rest[near])
            rest = rest[~near]
    return links


def _bucket_links(keys: np.ndarray, fps: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of rows that are sorted by key; large buckets give a forest for each radius."""
    if len(keys) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    left, right = [], []
    for shift in range(1, min(SMALL_BUCKET, len(keys))):
        pair = (keys[shift:] == keys[:-shift]) & small[shift:]
        if not pair.any():
            break
        a, b = fps[:-shift][pair], fps[shift:][pair]
        near = _near(a, b, radii[-1])
        left.append(a[near])
        right.append(b[near])
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        for bits in radii:
            found = np.array(_forest(fps[start : start + size], bits), np.uint64).reshape(-1, 2)
            left.append(found[:, 0])
            right.append(found[:, 1])
    return np.concatenate([*left, np.empty(0, np.uint64)]), np.concatenate([*right, np.empty(0, np.uint64)])


def _scan(radii: tuple[int, ...]):
    """Rows (key, fp, root) sorted by key to links; the last bucket of a batch waits for the next batch.

    Links inside a root are left out. Without the column root every fingerprint is its own.
    """

    def out(keys: np.ndarray, fps: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        a, b = _bucket_links(keys, fps, radii)
        if len(a):
            order = np.argsort(fps, kind="stable")
            root_a, root_b = (roots[order[np.searchsorted(fps, x, sorter=order)]] for x in (a, b))
            a, b = a[root_a != root_b], b[root_a != root_b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        columns = [pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            new = [new[0], new[1].view(np.uint64), new[-1].view(np.uint64)]
            keys, fps, roots = (np.r_[x, y] for x, y in zip(held, new, strict=True))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield out(keys[:cut], fps[:cut], roots[:cut])
            held = [keys[cut:], fps[cut:], roots[cut:]]
        yield out(*held)

    return run


def links(distinct: DataFrame, words: range = range(1), radii: tuple[int, ...] = (MAX_BITS,)) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp, wide) that keep every connection within the last radius of fp.

    With a column root, fingerprints of one root count as connected.
    """
    dealt = signature_keys(distinct, words).repartition(common.partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_scan(radii), "u long, v long").distinct()


def rooted(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """nodes (name, first_id, ...) joined by edges (u, v) between names, with root and component_id.

    Components run on nodes that carry their smallest doc_id in front of their name, so the least node
    of a component has its component_id, null only if all are null, and nothing is gathered by root.
    """
    own = F.struct(F.col("first_id").isNull().alias("missing"), F.col("first_id").alias("id"), F.col(name).alias("name"))
    ends = nodes.select(F.col(name).alias("end"), own.alias("is"))
    left, right = (ends.select(F.col("end").alias(x), F.col("is").alias(f"{x}_is")) for x in "uv")
    placed = edges.join(left, "u").join(right, "v").select(F.col("u_is").alias("u"), F.col("v_is").alias("v"))
    roots = star_components(placed).select(F.col("node.name").alias("of"), F.col("root").alias("to"))
    joined = nodes.join(roots, F.col(name) == F.col("of"), "left").withColumn("to", F.coalesce("to", own))
    return joined.select(*nodes.columns, F.col("to.name").alias("root"), F.col("to.id").alias("component_id"))


def _nodes(printed: DataFrame) -> DataFrame:
    return common.cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("wide").alias("wide")))


def components(printed: DataFrame) -> DataFrame:
    """Rows (fp, component_id, root) for the fingerprints in printed (doc_id, fp, wide), linked at MAX_BITS or fewer.

    root is a fingerprint of the component, the same for all of them.
    """
    nodes = _nodes(printed)
    return rooted(nodes, links(nodes), "fp").select("fp", "component_id", "root")


def kept(docs: DataFrame, width: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component of fingerprints one row with its smallest doc_id.

    Fingerprints of 64 bits meet under deletion-variant keys, are verified on all bits and link at
    MAX_BITS or fewer. A null or wordless text has fingerprint zero, which links like any other; of a component
    without any doc_id one row stays. Columns of docs may have any names. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("text"))
    printed = common.stored(fingerprints(rows, width, "__row"))
    found = components(printed.select("__row.doc_id", "fp", "wide"))
    least = F.col("__row.doc_id").eqNullSafe(F.col("component_id"))
    return printed.select("__row", "fp").join(found, "fp").where(least).dropDuplicates(["root"]).select("__row.*")


def bands(n: int) -> np.ndarray:
    """The places of the bits in each band, a row a band, for n fingerprints."""
    length = min(24, max(8, math.ceil(math.log2(n + 1) - math.log2(BAND_SIZE))))
    count = math.ceil(math.log(BAND_MISS) / math.log1p(-((1 - BAND_BITS / (64 * WIDE_WORDS)) ** length)))
    pick = np.random.default_rng(SEED)
    return np.stack([pick.choice(64 * WIDE_WORDS, length, replace=False) for _ in range(count)])


def _banded(nodes: DataFrame, places: np.ndarray) -> DataFrame:
    """Rows (key, node, root, wide binary) for nodes (node, root, wide), one a band, sorted by key."""
    weights = (1 << np.arange(places.shape[1])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                wide = part.column(2).flatten().to_numpy().reshape(-1, WIDE_WORDS)
                bits = np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1)
                keys = np.concatenate([bits[:, p] @ weights + (i << 32) for i, p in enumerate(places)])
                at = np.tile(np.arange(len(wide)), len(places))
                blobs = pa.array([w.tobytes() for w in wide], pa.binary())
                taken = [c.take(pa.array(at)) for c in (part.column(0), part.column(1), blobs)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *taken], ["key", "node", "root", "wide"])

    dealt = nodes.select("node", "root", "wide").mapInArrow(run, "key long, node long, root long, wide binary")
    return dealt.repartition(common.partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "node")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _first_word(bits: int) -> int:
    """Bits of the first word beyond which all words differ in more than bits, but for a pair in a million."""
    return math.ceil(bits / WIDE_WORDS + 5 * math.sqrt(bits / WIDE_WORDS * (1 - bits / (64 * WIDE_WORDS))))


def _wide_forest(wide: np.ndarray, roots: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of places: a spanning forest of the links within bits. What has been reached is not compared again."""
    links, rest, front = [np.empty((0, 2), np.int64)], np.arange(1, len(wide)), deque([0])
    first = np.ascontiguousarray(wide[:, 0])
    left = first[1:]
    while len(rest):
        if not front:
            front, rest, left = deque(rest[:1]), rest[1:], left[1:]
            continue
        one = front.popleft()
        maybe = np.flatnonzero(_near(left, first[one], _first_word(bits)))
        maybe = maybe[_distances(wide[rest[maybe]], wide[one]) <= bits]
        if len(maybe):
            links.append(np.stack([np.full(len(maybe), one), rest[maybe]], axis=1))
            front.extend(rest[maybe])
            rest, left = np.delete(rest, maybe), np.delete(left, maybe)
    return np.concatenate(links)


def _wide_pairs(wide: np.ndarray, roots: np.ndarray, bits: int) -> np.ndarray:
    """All pairs of places within bits whose roots differ."""
    found, first = [np.empty((0, 2), np.int64)], np.ascontiguousarray(wide[:, 0])
    step = max(1, (1 << 20) // len(wide))
    for start in range(0, len(wide) - 1, step):
        a, b = np.nonzero(_near(first[start : start + step, None], first[None, start + 1 :], _first_word(bits)))
        a, b = a + start, b + start + 1
        apart = (a < b) & (roots[a] != roots[b])
        a, b = a[apart], b[apart]
        near = _distances(wide[a], wide[b]) <= bits
        found.append(np.stack([a[near], b[near]], axis=1))
    return np.concatenate(found)


def _met(search, bits: int):
    """Rows (key, node, root, wide) sorted by key to the links (u, v) that search finds among those of one key."""

    def out(nodes: np.ndarray, roots: np.ndarray, blobs: list) -> pa.RecordBatch:
        wide = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, WIDE_WORDS)
        pairs = np.sort(nodes[search(wide, roots, bits)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if held and keys[start] != held_key:
                    yield flush(held)
                    held = []
                held_key = keys[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield flush(held)

    def flush(held: list) -> pa.RecordBatch:
        nodes, roots = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (1, 2))
        return out(nodes, roots, [x for h in held for x in h.column(3).to_pylist()])

    return run


def zipped(texts: DataFrame) -> DataFrame:
    """Rows (node, first_id, wide, text) of texts (node, wide, doc_id, text), one a node, the text compressed."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        blobs = pa.array([zlib.compress((t or "").encode(), 1) for t in batch.column(3).to_pylist()], pa.binary())
        return dict(zip(("node", "wide", "doc_id", "text"), (*batch.columns[:3], blobs), strict=True))

    found = common.map_rows(texts.select("node", "wide", "doc_id", "text"), "node long, wide array<long>, doc_id long, text binary", per_batch)
    return found.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("wide").alias("wide"), F.min("text").alias("text"))


def similar(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Rows (u, v, sure, near) for pairs (u, v, sure): whether their compressed texts (node, text) have a similarity of SIMILAR or more."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))

    def per_batch(batch: pa.RecordBatch) -> dict:
        known: dict[int, np.ndarray] = {}
        keep = []
        for u, v, _, text_u, text_v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for node, text in ((u, text_u), (v, text_v)):
                if node not in known:
                    known[node] = np.unique(shingle_hashes(zlib.decompress(text).lower().split(), width))
            a, b = known[u], known[v]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(shared >= SIMILAR * (len(a) + len(b) - shared))
        return {"u": batch.column(0), "v": batch.column(1), "sure": batch.column(2), "near": pa.array(keep, pa.bool_())}

    both = pairs.join(left, "u").join(right, "v").select("u", "v", "sure", "text_u", "text_v")
    return common.map_rows(both, "u long, v long, sure boolean, near boolean", per_batch)


def near_components(docs: DataFrame, width: int) -> DataFrame:
    """Rows (node, root, component_id) for docs (doc_id, text), joined where SIMILAR of their shingles or more are shared.

    A node is a fingerprint of WIDE_WORDS words. A forest of the closest pairs of each band holds large
    groups of near copies together, so that only pairs across its trees are tried besides. All of them
    are decided by their shingles; if a link of the forest fails, the pairs across what is left are tried too.
    """
    texts = fingerprints(docs.select(F.struct("doc_id", "text").alias("__row"), "text"), width, "__row", WIDE_WORDS)
    kept = common.stored(zipped(texts.select(node_of("wide").alias("node"), "wide", "__row.*")))
    nodes, texts = kept.select("node", "first_id", "wide"), kept.select("node", "text")
    places = bands(nodes.count())

    def met(found: DataFrame, search, bits: int) -> DataFrame:
        return _banded(found, places).mapInArrow(_met(search, bits), "u long, v long").distinct()

    forest = common.cut_lineage(met(nodes.withColumn("root", F.col("node")), _wide_forest, SURE_BITS).withColumn("sure", F.lit(True)))
    across = met(rooted(nodes, forest, "node"), _wide_pairs, WIDE_BITS).withColumn("sure", F.lit(False))
    decided = common.cut_lineage(similar(forest.union(across), texts, width))
    near = decided.where("near").select("u", "v")
    if decided.where("sure and not near").limit(1).count():
        again = met(rooted(nodes, near, "node"), _wide_pairs, WIDE_BITS).withColumn("sure", F.lit(False))
        near = near.union(similar(again, texts, width).where("near").select("u", "v"))
    return rooted(nodes, near, "node").select("node", "root", "component_id")


def node_of(wide: str) -> Column:
    return F.xxhash64(*[F.element_at(wide, i + 1) for i in range(WIDE_WORDS)])


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (__row, fp, root, component_id) for every row of docs; __row is a struct of all its columns.

    component_id is the smallest doc_id of the group; null where all of them are null. A null or
    empty text has fingerprint zero, which links like any other. Repeated rows share their
    fingerprint. An empty table gives no rows.
    """
    found = near_components(docs, width)
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("text"))
    printed = fingerprints(rows, width, "__row", WIDE_WORDS).withColumn("node", node_of("wide"))
    return printed.join(found, "node").select("__row", "fp", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates one row with its smallest doc_id."""
    candidates = near_duplicates(docs).where(F.col("__row.doc_id").eqNullSafe(F.col("component_id")))
    return candidates.dropDuplicates(["root"]).select("__row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint's component. A null or wordless text has fingerprint zero; repeated rows share theirs."""
    docs = common.documents(spark, sf_dir)
    printed = common.cut_lineage(fingerprints(docs, width=4))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return printed.join(components(printed), "fp").select("doc_id", text.alias("fingerprint"), "component_id")
