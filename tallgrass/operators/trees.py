"""Digests of file trees: every folder has one, made of those of its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import stored

#: A folder with more entries is cut into parts by the hash of their names, so that no group grows with the folder.
WIDE, PART_DIGITS = 4096, 3


def _listing() -> Column:
    """Entries in order of their names, each with its kind and digest."""
    line = F.concat_ws("\x00", "name", "kind", "digest")
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)


def _folders(entries: DataFrame, wide: int) -> DataFrame:
    """Digests (path, digest, n_files) of the folders that hold entries (folder, name, kind, digest, n_files)."""
    counts = entries.groupBy("folder").agg(F.count("*").alias("size"))
    part = F.when(F.col("size") > wide, F.substring(F.sha2("name", 256), 1, PART_DIGITS)).otherwise("")
    parts = entries.join(counts, "folder").groupBy("folder", part.alias("name")).agg(
        _listing().alias("digest"), F.sum("n_files").alias("n_files")
    )
    whole = parts.withColumn("kind", F.lit("part")).groupBy(F.col("folder").alias("path"))
    one = F.when(F.count_if(F.col("name") != "") == 0, F.max("digest"))
    return whole.agg(F.coalesce(one, _listing()).alias("digest"), F.sum("n_files").alias("n_files"))


def tree_digests(files: DataFrame, wide: int = WIDE) -> DataFrame:
    """Rows (path, kind, digest, n_files) for files (path, sha256) and every folder above them; the root's path is empty.

    A digest depends on names and contents below it only: not on the order or partitioning of rows, nor on where the
    tree lies. One changed file changes the digests of its folders up to the root and no others. Folders are made level
    by level from the deepest, a table each; repeated rows of one path count once, of different contents the first by
    digest. No files give no rows.
    """
    found = files.groupBy(F.ltrim("path", F.lit("/")).alias("path")).agg(F.min("sha256").alias("digest"))
    leaves = stored(found.select("path", F.lit("file").alias("kind"), "digest", F.lit(1).cast("long").alias("n_files")))
    depth = F.size(F.split("path", "/"))
    deepest = leaves.agg(F.max(depth)).first()[0]
    out, below = leaves, None
    for level in range(deepest or 0, 0, -1):
        here = leaves.where(depth == level)
        entries = here if below is None else here.unionByName(below)
        named = entries.select(T.parent("path").alias("folder"), T.file_name("path").alias("name"), "kind", "digest", "n_files")
        below = stored(_folders(named, wide).select("path", F.lit("folder").alias("kind"), "digest", "n_files"))
        out = out.unionByName(below)
    return out


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose digest differs between two tables of tree_digests, or that only one of them has."""
    a, b = (t.select("path", "kind", F.col("digest").alias(n)) for t, n in ((old, "was"), (new, "now")))
    return a.join(b, ["path", "kind"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", "kind", "was", "now")
