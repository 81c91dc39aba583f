"""Merkle manifest of a dataset, kept as blocks in van Emde Boas order.

Every tree is cut into aligned blocks, subtrees of a fixed height. A block's nodes lie in one array in the order of
van Emde Boas: the upper half of the levels first, then each lower subtree, every one of them laid out the same way.
`addresses` finds a node in it by arithmetic alone, both where a block is built and where siblings are read.

Blocks are the unit of distribution: tier 0 holds the leaves' blocks, their roots are the leaves of tier 1 and so on,
each tier smaller by 2 ** BLOCK_HEIGHT. A language is one tree; the languages' subroots are the leaves of one more.
Proofs go the other way: a block learns the path above it from the tier above, by a join of one row a block.
So no group is larger than a block, whatever share of the rows one language holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Levels below a block's root.
BLOCK_HEIGHT = 12
#: A table of this many rows at most is broadcast.
BROADCAST_ROWS = 20_000

DIGEST = 32
#: What a path says of a level: no sibling, or one digest to the left or to the right.
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """For each depth from the root to the leaves, where its nodes lie in a block of that height.

    The upper height // 2 levels (at least one) come first, then the subtrees hung below them from left to right.
    """
    if height == 0:
        return (np.zeros(1, np.int64),)
    top = (height + 1) // 2 - 1
    below = height - top - 1
    upper, lower = addresses(top), addresses(below)
    roots = np.arange(2 ** (top + 1), dtype=np.int64)
    starts = 2 ** (top + 1) - 1 + roots * (2 ** (below + 1) - 1)
    return upper + tuple((starts[:, None] + level[None, :]).ravel() for level in lower)


def joined_hash(*parts: bytes) -> bytes:
    """SHA-256 of digests that are concatenated as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def build_block(leaves: list[bytes], height: int) -> list[bytes | None]:
    """A block's nodes in van Emde Boas order; places to the right of the last leaf stay empty."""
    place = addresses(height)
    nodes: list[bytes | None] = [None] * (2 ** (height + 1) - 1)
    for at, leaf in zip(place[height].tolist(), leaves, strict=False):
        nodes[at] = leaf
    count = len(leaves)
    for depth in range(height - 1, -1, -1):
        children = place[depth + 1].tolist()
        parents = (count + 1) // 2
        for k, at in enumerate(place[depth][:parents].tolist()):
            pair = children[2 * k : min(2 * k + 2, count)]
            nodes[at] = joined_hash(*(nodes[c] for c in pair))
        count = parents
    return nodes


def path_of(nodes: bytes, leaf: int, count: int, height: int) -> bytes:
    """Siblings of a leaf up to its block's root, each after a byte that tells its side."""
    place = addresses(height)
    steps = []
    for depth in range(height, 0, -1):
        k = leaf >> (height - depth)
        width = -(-count >> (height - depth))
        if k ^ 1 < width:
            at = int(place[depth][k ^ 1]) * DIGEST
            steps.append((LEFT if k & 1 else RIGHT) + nodes[at : at + DIGEST])
        else:
            steps.append(ALONE)
    return b"".join(steps)


def steps_of(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(path):
        side = path[at : at + 1]
        size = 0 if side == ALONE else DIGEST
        yield side, path[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, steps: list[tuple[bytes, str]]) -> bytes:
    """The root that a leaf and the siblings (side, hexadecimal text) on its way lead to."""
    sha, node = hashlib.sha256, leaf.hex()
    for side, sibling in steps:
        node = sha((sibling + node if side == LEFT else node + sibling).encode()).hexdigest()
    return bytes.fromhex(node)


# ---------------------------------------------------------------------------------------------------------- positions


def positions(leaves: DataFrame) -> DataFrame:
    """leaves (tree, key long, leaf binary, claim binary, salt long) with pos, the place in their tree by (key, leaf).

    Rows are sorted over ranges of (tree, key, leaf, salt) and counted inside each range; each range then learns how
    many rows of the tree precede it. Rows equal in all but salt are alike, so their order among themselves is free.
    """
    spark = leaves.sparkSession
    order = ["tree", F.col("key").asc_nulls_first(), "leaf", "salt"]
    sorted_ = leaves.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    numbered = common.stored(
        sorted_.withColumn("part", F.spark_partition_id())
        .drop("salt")
        .mapInArrow(_count_runs, "tree string, key long, leaf binary, claim binary, part int, run_pos long")
    )
    runs = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.stored(runs.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return numbered.join(_small(starts), ["tree", "part"]).select(
        "tree", "key", "leaf", "claim", (F.col("start") + F.col("run_pos")).alias("pos")
    )


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seen = None, 0
    for batch in batches:
        trees = batch.column(0).to_pylist()
        places = []
        for tree in trees:
            if tree != last:
                last, seen = tree, 0
            places.append(seen)
            seen += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "run_pos"]
        )


def _small(df: DataFrame) -> DataFrame:
    """df, a stored table, marked for broadcast if its row count allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# --------------------------------------------------------------------------------------------------------------- trees

BLOCK_SCHEMA = (
    "tree string, block long, leaves int, height int, keys array<long>, claims array<binary>, nodes binary, root binary"
)


def levels(count: Column) -> Column:
    """Levels above the leaves of a tree with that many, by whole numbers."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count - 1))).cast("int")


def build_tiers(leaves: DataFrame, block_height: int = BLOCK_HEIGHT) -> list[DataFrame]:
    """Tiers of blocks over leaves (tree, pos, leaf, key, claim), each stored; empty without leaves.

    The last tier has one block for each tree that reaches it; a lower tree ends in a tier before.
    """
    sizes = common.stored(leaves.groupBy("tree").agg(levels(F.count("*")).alias("left")))
    tallest = sizes.agg(F.max("left")).first()[0]
    if tallest is None:
        return []
    tiers: list[DataFrame] = []
    rows = leaves
    for base in range(0, max(tallest, 1), block_height):
        tier = _build_tier(rows, sizes.select("tree", F.col("left") - base), block_height)
        tiers.append(tier)
        rows = (
            tier.join(sizes.where(F.col("left") > base + block_height), "tree", "left_semi")
            .select("tree", F.col("block").alias("pos"), F.col("root").alias("leaf"))
            .withColumns({"key": F.lit(None).cast("long"), "claim": F.lit(None).cast("binary")})
        )
    return tiers


def _build_tier(rows: DataFrame, left: DataFrame, block_height: int) -> DataFrame:
    """One tier, from leaves and the levels that each tree has left above them."""

    def build(leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        digests = leaves.column("leaf").to_pylist()
        height = min(block_height, leaves.column("left")[0].as_py())
        nodes = build_block(digests, height)
        columns = {
            "tree": leaves.column("tree")[0].as_py(),
            "block": leaves.column("pos")[0].as_py() >> block_height,
            "leaves": len(digests),
            "height": height,
            "keys": leaves.column("key").to_pylist(),
            "claims": leaves.column("claim").to_pylist(),
            "nodes": b"".join(n or bytes(DIGEST) for n in nodes),
            "root": nodes[0],
        }
        return pa.Table.from_pylist([columns], schema=BLOCK_ARROW)

    left = left.toDF("tree", "left")
    with_levels = rows.join(_small(common.stored(left)), "tree")
    block = F.shiftright("pos", block_height).alias("block")
    return common.stored(with_levels.groupBy("tree", block).applyInArrow(lambda t: build(t), BLOCK_SCHEMA))


BLOCK_ARROW = pa.schema(
    [
        ("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()),
        ("keys", pa.list_(pa.int64())), ("claims", pa.list_(pa.binary())), ("nodes", pa.binary()), ("root", pa.binary()),
    ]
)


def roots(tiers: list[DataFrame], block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """(tree, root) of every tree: the root of its only block in the last tier that has one."""
    tops = [
        tier.select("tree", "root", "block", F.lit(t).alias("tier")) for t, tier in enumerate(tiers)
    ]
    every = tops[0]
    for tier in tops[1:]:
        every = every.unionByName(tier)
    return every.groupBy("tree").agg(F.max_by("root", "tier").alias("root"))


def proof_paths(tiers: list[DataFrame], above: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """Each block of tier 0 with path, what leads from its root to the end; above has (tree, path) of every root."""
    paths = None
    for t in range(len(tiers) - 1, -1, -1):
        tier = tiers[t]
        if paths is None:
            tier = tier.join(above, "tree")
        else:
            alone = tier.join(paths.select("tree").distinct(), "tree", "left_anti").join(above, "tree")
            tier = tier.join(paths, ["tree", "block"]).unionByName(alone)
        if t:
            paths = common.stored(tier.mapInArrow(_child_paths(block_height), "tree string, block long, path binary"))
    return tier


def _child_paths(block_height: int):
    """From blocks with their own path to the path of each of their leaves, the blocks of the tier below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] << block_height
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "tree": row["tree"],
                            "block": first + k,
                            "path": path_of(row["nodes"], k, row["leaves"], row["height"]) + row["path"],
                        }
                        for k in range(row["leaves"])
                    ],
                    schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.binary())]),
                )

    return run


# ------------------------------------------------------------------------------------------------------------- dataset


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; whole numbers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """SHA-256 of a document's five fields, as binary."""
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang")]
    fields += [field(F.col("n_chars") if n_chars is None else n_chars), field(F.col("text"))]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def tree_key() -> Column:
    """The tree of a document: null before every language, languages by their bytes."""
    return F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang")))


def tampered(modulus: int = 7) -> Column:
    """Documents of the check whose n_chars is raised by one; a null doc_id is not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, F.lit(False))


def manifest(leaves: DataFrame, block_height: int = BLOCK_HEIGHT) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Blocks of the languages' trees, blocks of the tree over their subroots, and the ranked subroots.

    leaves: (tree, key, leaf, claim, salt); claim is the digest that a document has now, null if unchanged.
    """
    tiers = build_tiers(positions(leaves), block_height)
    if not tiers:
        return [], [], None
    subroots = common.stored(roots(tiers, block_height))
    no_key = F.lit(None).cast("long")
    ranked = common.stored(
        positions(
            subroots.select(
                F.lit("").alias("tree"), no_key.alias("key"), F.encode("tree", "utf-8").alias("leaf"),
                F.col("root").alias("claim"), F.lit(0).cast("long").alias("salt"),
            )
        ).select("tree", F.decode("leaf", "utf-8").alias("of_tree"), "pos", F.col("claim").alias("leaf"))
    )
    top = build_tiers(
        ranked.select("tree", "pos", "leaf", no_key.alias("key"), F.lit(None).cast("binary").alias("claim")),
        block_height,
    )
    return tiers, top, ranked


PROOF_SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def proofs(leaves: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """A row for each leaf: its digest, subroot, root, the digest of its siblings, and what its claim folds to.

    Rows of one doc_id are ordered by their digests, null doc_ids come first. Without leaves there are no rows.
    """
    tiers, top, ranked = manifest(leaves, block_height)
    if not tiers:
        return leaves.sparkSession.createDataFrame([], PROOF_SCHEMA)
    root = roots(top, block_height).first()["root"]
    empty = leaves.sparkSession.createDataFrame([("", b"")], "tree string, path binary")
    to_end = proof_paths(top, empty, block_height).mapInArrow(
        _child_paths(block_height), "tree string, block long, path binary"
    )
    above = common.stored(
        ranked.join(to_end.select(F.col("block").alias("pos"), "path"), "pos").select(
            F.col("of_tree").alias("tree"), "path", F.col("leaf").alias("subroot")
        )
    )
    blocks = proof_paths(tiers, above.select("tree", "path"), block_height)
    return blocks.join(_small(above.select("tree", "subroot")), "tree").mapInArrow(_prove(root), PROOF_SCHEMA)


def _prove(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _prove_block(batch.slice(k, 1).to_pylist()[0], root)

    return run


def _prove_block(row: dict, root: bytes) -> pa.RecordBatch:
    """Proofs of a block's leaves."""
    place, nodes = addresses(row["height"])[row["height"]], row["nodes"]
    above = [(side, sibling.hex()) for side, sibling in steps_of(row["path"])]
    out: dict[str, list] = {"leaf": [], "proof": [], "folded": []}
    for k, claim in enumerate(row["claims"]):
        at = int(place[k]) * DIGEST
        leaf = nodes[at : at + DIGEST]
        own = path_of(nodes, k, row["leaves"], row["height"])
        steps = [(side, sibling.hex()) for side, sibling in steps_of(own)] + above
        out["leaf"].append(leaf.hex())
        out["proof"].append(hashlib.sha256("".join(s for _, s in steps).encode()).hexdigest())
        out["folded"].append(fold(claim or leaf, steps).hex())
    size, whole = len(out["leaf"]), root.hex()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["keys"], pa.int64()),
            pa.array(out["leaf"]),
            pa.array([row["subroot"].hex()] * size),
            pa.array([whole] * size),
            pa.array(out["proof"]),
            pa.array(out["folded"]),
            pa.array([f == whole for f in out["folded"]]),
        ],
        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    )


def document_leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Leaves of docs (doc_id, source, lang, n_chars, text), other columns ignored; nulls are fields of their own.

    altered marks the documents that are checked with an n_chars larger by one than in the manifest; a null n_chars stays.
    The text is read once: what goes on is a digest or two a document.
    """
    claim = F.lit(None).cast("binary")
    if altered is not None:
        claim = F.when(altered & F.col("n_chars").isNotNull(), leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1))
    return common.stored(
        docs.select(
            tree_key().alias("tree"),
            F.col("doc_id").cast("long").alias("key"),
            leaf_digest().alias("leaf"),
            claim.alias("claim"),
            F.monotonically_increasing_id().alias("salt"),
        )
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, proof and check; every seventh by crc32 is checked against a changed n_chars."""
    return proofs(document_leaves(common.documents(spark, sf_dir), tampered()))


SQL = """
WITH RECURSIVE
fields AS (
    SELECT doc_id, lang, n_chars,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
           CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree,
           -- crc32 of the decimal doc_id, bit by bit
           xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda crc, b: list_reduce(range(8),
                   lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)),
               CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS crc
    FROM documents
),
leaves AS (
    SELECT doc_id, tree,
           sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
           CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
                THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS claim
    FROM fields
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
),
low AS (
    SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM ranked
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
    FROM low WHERE n > 1 GROUP BY tree, level, pos // 2
),
subroots AS (
    SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM low WHERE n = 1
),
high AS (
    SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
    FROM high WHERE n > 1 GROUP BY level, pos // 2
),
in_low AS (
    SELECT r.tree, r.pos AS leaf_pos, 0 AS level, r.pos, coalesce(r.claim, r.leaf) AS folded, '' AS proof FROM ranked r
    UNION ALL
    SELECT i.tree, i.leaf_pos, i.level + 1, i.pos // 2,
           sha256(CASE WHEN i.pos % 2 = 1 THEN coalesce(s.h, '') || i.folded ELSE i.folded || coalesce(s.h, '') END),
           i.proof || coalesce(s.h, '')
    FROM in_low i
    JOIN low own ON own.tree = i.tree AND own.level = i.level AND own.pos = i.pos AND own.n > 1
    LEFT JOIN low s ON s.tree = i.tree AND s.level = i.level AND s.pos = xor(i.pos, 1)
),
at_subroot AS (
    SELECT i.tree, i.leaf_pos, i.folded, i.proof, s.pos, s.subroot
    FROM in_low i JOIN low own ON own.tree = i.tree AND own.level = i.level AND own.n = 1
    JOIN subroots s ON s.tree = i.tree
),
in_high AS (
    SELECT tree, leaf_pos, 0 AS level, pos, folded, proof FROM at_subroot
    UNION ALL
    SELECT i.tree, i.leaf_pos, i.level + 1, i.pos // 2,
           sha256(CASE WHEN i.pos % 2 = 1 THEN coalesce(s.h, '') || i.folded ELSE i.folded || coalesce(s.h, '') END),
           i.proof || coalesce(s.h, '')
    FROM in_high i
    JOIN high own ON own.level = i.level AND own.pos = i.pos AND own.n > 1
    LEFT JOIN high s ON s.level = i.level AND s.pos = xor(i.pos, 1)
)
SELECT r.doc_id, r.leaf, s.subroot, top.h AS root, sha256(i.proof) AS proof_sha256, i.folded AS folded_root,
       i.folded = top.h AS verified
FROM ranked r
JOIN subroots s ON s.tree = r.tree
JOIN high top ON top.n = 1
JOIN in_high i ON i.tree = r.tree AND i.leaf_pos = r.pos AND i.level = top.level
"""
