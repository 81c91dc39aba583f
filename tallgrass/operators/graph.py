"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges (source, target) from imports (source, module, name) to modules (module, path).

    Tried are module.name, the module, and its shorter beginnings; the first that exists wins. What is
    imported is resolved once, however many sources import it.
    """
    asked = imports.select("module", "name").distinct()
    parts = F.split("module", r"\.")
    shorter = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))
    named = F.when(F.col("name").isNotNull(), F.array(F.concat_ws(".", "module", "name"))).otherwise(F.array().cast("array<string>"))
    tried = asked.select("module", "name", F.posexplode(F.concat(named, shorter)).alias("place", "candidate"))
    found = tried.join(modules.select(F.col("module").alias("candidate"), "path"), "candidate")
    best = found.groupBy("module", "name").agg(F.min_by("path", "place").alias("target"))
    # Imports are never the side that is broadcast: one task would then make all edges.
    best = best.select(F.col("module").alias("of_module"), F.col("name").alias("of_name"), "target").hint("merge")
    edges = imports.join(best, (F.col("module") == F.col("of_module")) & F.col("name").eqNullSafe(F.col("of_name")))
    return edges.where("source <> target").select("source", "target").distinct()


def test_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source is a test and whose target is not; files (path, is_test)."""
    kinds = [files.select(F.col("path").alias(side), F.col("is_test").alias(f"{side}_test")) for side in ("source", "target")]
    return imports.join(kinds[0], "source").join(kinds[1], "target").where("source_test and not target_test").select("source", "target")


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("in_degree"))


def importance(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Scores of files: three for each importer, two for each class, one for each of up to three public names."""
    degree = in_degrees(edges).select(F.col("node").alias("path"), "in_degree")
    public = ~F.col("name").startswith("_")
    counts = symbols.groupBy("path").agg(
        F.count_if(F.col("kind") == "class").alias("n_classes"), F.least(F.lit(3), F.count_if(public)).alias("n_public")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = 3 * zero("in_degree") + 2 * zero("n_classes") + zero("n_public")
    return degree.join(counts, "path", "full").select("path", score.alias("score"))


def _mark(edges: DataFrame) -> tuple:
    """Count and content hash of a table of edges; equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of edges (u, v): root is the smallest node of its component.

    Alternates large-star and small-star rounds: the first hangs every larger neighbour of a node
    on its smallest neighbour, the second does so with the smaller ones. The edges never become
    more than the input's, no adjacency list is built, and rounds grow with the logarithm of the
    longest path. Nodes may be of any type that has an order, structs included. Self loops and repeated
    edges are allowed; no edges give no rows.
    """
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = cut_lineage(edges.where("u <> v").select(larger, smaller).distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("least").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for undirected edges (source, target): the least node reachable. A loop makes its node a component."""
    roots = star_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")), max_rounds)
    found = roots.select("node", F.col("root").alias("component"))
    loops = edges.where("source = target").select(F.col("source").alias("node")).distinct()
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def cluster_shares(labels: DataFrame) -> DataFrame:
    """One row a component: its size and its share of all nodes."""
    n = labels.count()
    return labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("share", F.col("size") / F.lit(n))
