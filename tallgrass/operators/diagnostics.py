"""What a choice of files rests on: decisions by path, and kinds of evidence, coverage, scores and spread by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .storage import stored

# Kinds of match that speak for a file itself, and those that come from its neighbours.
DIRECT = ("explicit_path", "trace_path", "exact_symbol", "filename_term", "symbol_term")
GRAPH = ("import_neighbor", "reverse_import_neighbor", "related_test", "tested_source")
# How specific the best evidence for a path is, strongest first.
SPECIFICITY = ("VERY_STRONG", "STRONG", "AMBIGUOUS_DIRECT", "WEAK", "GRAPH", "NONE")
FRACTIONS = (50, 75, 90)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is nothing."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def path_decisions(ranges: DataFrame) -> DataFrame:
    """One row a query and path from its ranges (query_id, path, cost, phase, reason): cost, whether any was taken, why not all.

    A range was taken if it has a phase. A path of which some are taken is only partly left out; lack of budget goes before
    the limit of depth.
    """
    because = lambda r: F.coalesce(F.bool_or(F.col("reason") == r), F.lit(False))
    taken = F.col("phase").isNotNull()
    each = ranges.groupBy("query_id", "path").agg(
        F.sum("cost").alias("cost"), F.coalesce(F.sum(F.when(taken, F.col("cost"))), F.lit(0)).alias("taken_cost"),
        F.count("*").alias("n_ranges"), F.count_if(taken).alias("n_taken"), F.array_sort(F.collect_set("phase")).alias("phases"),
        because("context_budget").alias("short"), because("depth_limit").alias("deep"), F.max("reason").alias("any"),
    )
    some, name = F.col("n_taken") > 0, F.when(F.col("short"), "context_budget")
    whole = name.when(F.col("deep"), "depth_limit").otherwise("outside_task_cluster")
    partly = F.concat(F.lit("partial_"), name.otherwise("depth_limit"))
    return each.withColumn("omission", F.when(F.col("any").isNotNull(), F.when(some, partly).otherwise(whole))).drop("short", "deep", "any")


def path_evidence(selected: DataFrame, signals: DataFrame, useful: DataFrame, symbol_files: DataFrame) -> DataFrame:
    """Each selected (query_id, path, ...) with what kinds of signals it has and how specific they are.

    signals are (query_id, path, kind, key, term), useful (query_id, term), symbol_files (name, n_files): in how many files a
    symbol of that name is. An exact symbol in one file only is unique, in several ambiguous; one in none is neither.
    """
    keys = ["query_id", "path"]
    known = signals.join(useful.select("query_id", "term", F.lit(True).alias("counts")).distinct(), ["query_id", "term"], "left")
    name = F.when((F.col("kind") == "exact_symbol") & F.col("key").startswith("symbol:"), F.substring("key", 8, 1 << 20)).alias("name")
    known = known.select(*keys, "kind", "term", "counts", name).join(symbol_files.select("name", "n_files"), "name", "left")
    direct, near = F.col("kind").isin(*DIRECT), F.col("kind").isin(*GRAPH)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = known.groupBy(*keys).agg(
        any_of(direct).alias("direct"), any_of(near).alias("graph"), any_of(~direct & ~near).alias("weak"),
        any_of(F.col("kind").isin("explicit_path", "trace_path")).alias("named"), any_of(F.col("kind").isin("filename_term", "symbol_term")).alias("worded"),
        any_of(F.col("n_files") == 1).alias("unique_symbol"), any_of(F.col("n_files") > 1).alias("ambiguous_symbol"), F.count("*").alias("n_signals"),
    )
    flags = ["direct", "graph", "weak", "named", "worded", "unique_symbol", "ambiguous_symbol"]
    both = selected.join(each, keys, "left").fillna(False, flags).fillna(0, ["n_signals"])
    level = (
        F.when(F.col("named") | F.col("unique_symbol"), SPECIFICITY[0]).when(F.col("worded"), SPECIFICITY[1])
        .when(F.col("ambiguous_symbol"), SPECIFICITY[2]).when(F.col("weak"), SPECIFICITY[3]).when(F.col("graph"), SPECIFICITY[4])
    )
    return both.withColumn("specificity", level.otherwise(SPECIFICITY[5])).drop("named", "worded")


def term_coverage(selected: DataFrame, signals: DataFrame, useful: DataFrame) -> DataFrame:
    """One row a query of useful (query_id, term): its terms, those that selected paths support, directly or at all, and novel paths.

    Of the selected in order of place, a path is novel if it supports a useful term that none before it does.
    """
    terms = useful.select("query_id", "term").distinct()
    held = signals.where("term is not null").join(selected.select("query_id", "path", "place"), ["query_id", "path"]).join(terms, ["query_id", "term"], "left_semi")
    by_term = held.groupBy("query_id", "term").agg(F.bool_or(F.col("kind").isin(*DIRECT)).alias("direct"), F.min(F.struct("place", "path")).alias("first"))
    counted = by_term.groupBy("query_id").agg(
        F.count("*").alias("n_supported"), F.count_if("direct").alias("n_direct"), F.count_distinct("first.path").alias("n_novel_paths")
    )
    found = terms.groupBy("query_id").agg(F.count("*").alias("n_useful")).join(counted, "query_id", "left")
    found = found.fillna(0, ["n_supported", "n_direct", "n_novel_paths"])
    return found.withColumns({"coverage": ratio(F.col("n_supported"), F.col("n_useful")), "direct_coverage": ratio(F.col("n_direct"), F.col("n_useful"))})


def score_spread(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a query of candidates (query_id, path, score): its best score, and how the selected ones lie below it.

    median_score is exact; within_N_percent is the share of the selected that reach N percent of the best score.
    """
    best = candidates.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.max("score").alias("top_score"))
    both = selected.select("query_id", "score").join(best, "query_id")
    reached = [F.count_if(F.col("score") >= F.col("top_score") * p / 100).alias(f"within_{p}_percent") for p in FRACTIONS]
    spread = both.groupBy("query_id").agg(F.count("*").alias("n"), F.percentile("score", 0.5).alias("median_score"), F.min("score").alias("least_score"), *reached)
    found = best.join(spread, "query_id", "left").fillna(0, ["n"]).fillna(0.0, ["median_score", "least_score"])
    shares = {f"within_{p}_percent": ratio(F.coalesce(f"within_{p}_percent", F.lit(0)), F.col("n")) for p in FRACTIONS}
    return found.withColumns(shares).withColumn("median_to_top", ratio(F.col("median_score"), F.col("top_score"))).withColumnRenamed("n", "n_selected")


def folder_spread(selected: DataFrame) -> DataFrame:
    """One row a query: folders of its selected paths, their number by path, and the share of the fullest."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    each = selected.groupBy("query_id", folder.alias("folder")).agg(F.count("*").alias("n"))
    found = each.groupBy("query_id").agg(F.count("*").alias("n_folders"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return found.select("query_id", "n_folders", ratio(F.col("n_folders"), F.col("n")).alias("dispersion"), ratio(F.col("most"), F.col("n")).alias("largest_folder_share"))


def cluster_spread(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a query: connected groups of its selected paths by edges (source, target, kind) between them, and the largest's share.

    Imports and tests connect, either way. Groups of all queries are found at once, as nodes of query and path.
    """
    own = selected.select("query_id", "path").distinct()
    links = edges.where(F.col("kind").isin("IMPORTS", "TESTS")).select("source", "target").where("source <> target")
    # Edges are read once, and only those between selected paths are compared.
    inside = links.join(own.withColumnRenamed("path", "source"), "source").join(own.withColumnRenamed("path", "target"), ["query_id", "target"])
    inside = stored(inside.select("query_id", "source", "target").distinct())
    node = lambda c: F.struct("query_id", F.col(c).alias("path"))
    groups = graph.components(inside.select(node("source").alias("source"), node("target").alias("target")))
    labels = groups.select("node.query_id", "node.path", F.col("component.path").alias("cluster"))
    sizes = own.join(labels, ["query_id", "path"], "left").groupBy("query_id", F.coalesce("cluster", "path").alias("cluster")).agg(F.count("*").alias("n"))
    found = sizes.groupBy("query_id").agg(F.count("*").alias("n_clusters"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return found.select("query_id", "n_clusters", ratio(F.col("most"), F.col("n")).alias("largest_cluster_share"))


def locator(selected: DataFrame, candidates: DataFrame, signals: DataFrame, useful: DataFrame, symbol_files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a query with candidates: counts and shares of what its selected (query_id, path, place, score, role, is_test) rest on.

    A query of which nothing is selected has zeros. candidates, signals, useful, symbol_files and edges are those of the parts
    above. A path is weak only if nothing speaks for it directly, and expanded if it is RELATED by neighbours alone.
    """
    each = path_evidence(selected, signals, useful, symbol_files)
    counts = {
        "n_primary": F.col("role") == "PRIMARY", "n_related": F.col("role") == "RELATED", "n_test": F.col("is_test"), "direct_paths": F.col("direct"),
        "weak_only_paths": ~F.col("direct"), "graph_expanded": (F.col("role") == "RELATED") & F.col("graph") & ~F.col("direct"),
        "unique_symbol_paths": F.col("unique_symbol"), "ambiguous_symbol_paths": F.col("ambiguous_symbol"),
        "ambiguous_only_paths": F.col("ambiguous_symbol") & ~F.col("unique_symbol"), **{s.lower(): F.col("specificity") == s for s in SPECIFICITY},
    }
    kinds = each.groupBy("query_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.sum("n_signals").alias("n_signals"))
    found = score_spread(selected, candidates)
    for part in (kinds, term_coverage(selected, signals, useful), folder_spread(selected), cluster_spread(selected, edges)):
        found = found.join(part, "query_id", "left")
    found = found.fillna(0)
    return found.withColumns({
        "direct_ratio": ratio(F.col("direct_paths"), F.col("n_selected")), "weak_only_ratio": ratio(F.col("weak_only_paths"), F.col("n_selected")),
        "novel_path_ratio": ratio(F.col("n_novel_paths"), F.col("n_selected")),
    })
