"""Which ranked files belong to the cluster of a task, by the graph of imports around its anchors.

Anchors are the files that a query names, the best source file if it names none, and up to three more that are linked to
them. The cluster starts with the anchors' neighbours and then grows in order of rank: a strong file that is already in
it brings in its own neighbours, which counts for the files ranked after it, not for those before.

The graph is cut down to links between files of one ranking by joins; the two walks in order of rank are folds over the
ranking's array, so a query is one row and its array is as long as its ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Matches that make a file strong, those that name it, how many anchors there may be, the score that spreads.
STRONG = ("explicit_path", "trace_path", "exact_symbol", "filename_term")
NAMED = ("explicit_path", "trace_path", "exact_symbol")
ANCHORS, FALLBACK_ANCHORS, SPREADS = 3, 2, 80.0

KEYS = ["query_id", "path"]
_NO_PATHS = "array<string>"


def _has(kinds: tuple[str, ...]) -> Column:
    return F.exists("signals", lambda s: s["kind"].isin(*kinds))


def links(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (query_id, path, other, forward) for imports between two files of one ranking, from either side.

    Edges without two ranked ends go first. What is left is joined by file and then by query and file, so no pairs of
    files are made that no edge joins; a file with very many edges is a skewed key of plain joins.
    """
    ranked = candidates.select("path").distinct()
    used = edges.where("kind = 'IMPORTS'").select("source", "target").distinct()
    for side in ("source", "target"):
        used = used.join(ranked.withColumnRenamed("path", side), side, "left_semi")
    both = used.select(F.col("source").alias("path"), F.col("target").alias("other"), F.lit(True).alias("forward")).unionByName(
        used.select(F.col("target").alias("path"), F.col("source").alias("other"), F.lit(False).alias("forward"))
    )
    others = candidates.select("query_id", F.col("path").alias("other"), F.col("is_test").alias("other_test"))
    return candidates.select(*KEYS).join(both, "path").join(others, ["query_id", "other"])


def best_tests(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (query_id, path, test): of the ranked tests of a ranked file the one with the highest score, then the first path."""
    tests = edges.where("kind = 'TESTS'").select(F.col("source").alias("test"), F.col("target").alias("path"))
    scored = candidates.select("query_id", F.col("path").alias("test"), "score")
    found = candidates.select(*KEYS).join(tests, "path").join(scored, ["query_id", "test"])
    return found.groupBy(*KEYS).agg(F.min_by("test", F.struct(-F.col("score"), F.col("test"))).alias("test"))


def clusters(ranked: DataFrame, files: DataFrame, edges: DataFrame, spreads: float = SPREADS) -> DataFrame:
    """Rows (query_id, path, anchor, affinity) for ranked (query_id, path, rank, score, role, signals).

    files have path and is_test, edges source, target and kind (IMPORTS or TESTS). If ranked has a boolean column
    tests_requested, the best test is an anchor of the queries where it is true. Files that are ranked but not among
    files count as sources. No ranked files give no rows.
    """
    asked = F.coalesce("tests_requested", F.lit(False)) if "tests_requested" in ranked.columns else F.lit(False)
    tests = files.select("path", "is_test").dropDuplicates(["path"])
    candidates = ranked.join(tests, "path", "left").select(
        *KEYS, "rank", "score", F.coalesce("is_test", F.lit(False)).alias("is_test"), asked.alias("asked"),
        _has(STRONG).alias("strong"), _has(NAMED).alias("named"), (F.col("role") == "PRIMARY").alias("primary"),
    )
    near = links(candidates, edges).groupBy(*KEYS).agg(
        F.collect_set("other").alias("linked"),
        F.collect_set(F.when(F.col("forward") | ~F.col("other_test"), F.col("other"))).alias("reach"),
    )
    full = candidates.join(near, KEYS, "left").join(best_tests(candidates, edges), KEYS, "left")
    none = F.array().cast(_NO_PATHS)
    entry = F.struct(
        "rank", "path", "is_test", "strong", "named",
        (F.col("primary") & (F.col("score") >= spreads) & ~F.col("is_test")).alias("spreads"),
        F.coalesce("linked", none).alias("linked"), F.coalesce("reach", none).alias("reach"),
        F.array_compact(F.array("test")).alias("tests"),
    )
    listed = full.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("files"), F.bool_or("asked").alias("asked"))
    anchored = listed.withColumn("anchors", _anchors("files", F.col("asked")))
    grown = anchored.withColumn("cluster", _grown("files", "anchors"))
    each = grown.select("query_id", "anchors", "cluster", F.explode("files.path").alias("path"))
    return each.select(
        *KEYS, F.array_contains("anchors", F.col("path")).alias("anchor"), F.array_contains("cluster", F.col("path")).alias("affinity")
    )


def _paths(files: Column) -> Column:
    return F.transform(files, lambda f: f["path"])


def _anchors(files: str, asked: Column) -> Column:
    strong = F.filter(files, lambda f: f["strong"])
    sources = F.filter(strong, lambda f: ~f["is_test"])
    named = _paths(F.filter(strong, lambda f: f["named"]))
    first = F.when(F.size(named) > 0, named).otherwise(_paths(F.slice(sources, 1, 1)))
    test = F.slice(F.filter(strong, lambda f: f["is_test"]), 1, 1)
    begun = F.array_union(first, F.when(asked, _paths(test)).otherwise(F.array().cast(_NO_PATHS)))

    def join(anchors: Column, f: Column) -> Column:
        wanted = (F.size(anchors) < ANCHORS) & F.arrays_overlap(f["linked"], anchors)
        return F.when(wanted, F.array_union(anchors, F.array(f["path"]))).otherwise(anchors)

    walked = F.reduce(sources, begun, join)
    return F.when(F.size(walked) > 0, walked).otherwise(_paths(F.slice(files, 1, FALLBACK_ANCHORS)))


def _grown(files: str, anchors: str) -> Column:
    of_anchors = F.filter(files, lambda f: F.array_contains(F.col(anchors), f["path"]))
    around = F.flatten(F.transform(of_anchors, lambda f: F.concat(f["reach"], f["tests"])))

    def grow(cluster: Column, f: Column) -> Column:
        return F.when(f["spreads"] & F.array_contains(cluster, f["path"]), F.array_union(cluster, f["reach"])).otherwise(cluster)

    return F.reduce(files, F.array_union(anchors, around), grow)
