"""Packs that grow from one generation to the next.

A request names what a reader wants more of. It becomes ranges that the next pack has to hold, beside all that the pack
before it held; what is sent is only what the reader does not have yet, by intervals of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import intervals, packing

KEYS = packing.KEYS
#: Kinds of request.
KINDS = ("next_candidates", "symbol", "related_imports", "related_tests", "full_file", "surrounding_lines", "file")
#: Lines of a file that a request for the file shows, and lines around a range.
FILE_LINES, SURROUNDING = 80, 20

RANGE = (*KEYS, "start", "end")


def _range(rows: DataFrame, start: Column, end: Column, kind: str) -> DataFrame:
    return rows.select(*KEYS, start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def requested(
    requests: DataFrame, held: DataFrame, ranked: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame
) -> DataFrame:
    """Rows (query_id, path, start, end, kind): the lines that requests ask for.

    requests: (query_id, kind, target, lines); a null target means the first range held, null lines the default.
    held: (query_id, path, start, end, priority), what the pack has; ranked: (query_id, path, rank); symbols: (path, name,
    qualified_name, start_line, end_line); files: (path, line_count); edges: (source, target, kind).

        next_candidates     line 1 of the best ranked file that the pack has nothing of
        symbol              where symbols of that name or qualified name stand
        related_imports     the files that the target imports, whole
        related_tests       the tests of the target, whole
        full_file           the target
        surrounding_lines   the ranges held of the target, with lines before and after each
        file                the target's first 80 lines

    A request of another kind or for what does not exist asks for nothing.
    """
    lengths = files.select("path", F.greatest(F.lit(1), F.col("line_count")).cast("long").alias("length"))
    first = held.groupBy("query_id").agg(F.min_by("path", F.struct("priority", "path", "start")).alias("first"))
    aimed = requests.join(first, "query_id", "left").select("query_id", "kind", F.coalesce("target", "first").alias("target"), "lines")
    of = lambda *kinds: aimed.where(F.col("kind").isin(*kinds))
    one = F.lit(1)

    unseen = ranked.select(*KEYS, "rank").join(held.select(*KEYS).distinct(), KEYS, "left_anti")
    best = unseen.groupBy("query_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    following = of("next_candidates").select("query_id").distinct().join(best, "query_id")

    names = F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("target")
    spans = symbols.select("path", "start_line", "end_line", names)
    spoken = of("symbol").join(spans, "target")

    imports = edges.where("kind = 'IMPORTS'").select(F.col("source").alias("target"), F.col("target").alias("path"))
    tests = edges.where("kind = 'TESTS'").select("target", F.col("source").alias("path"))
    related = of("related_imports").join(imports, "target").unionByName(of("related_tests").join(tests, "target"))

    itself = of("full_file", "file").withColumnRenamed("target", "path").join(lengths, "path")
    end = F.when(F.col("kind") == "file", F.least("length", F.lit(FILE_LINES))).otherwise(F.col("length"))

    more = F.coalesce("lines", F.lit(SURROUNDING))
    around = of("surrounding_lines").withColumnRenamed("target", "path").join(held.select(*RANGE), KEYS)

    return reduce(
        DataFrame.unionByName,
        [
            _range(following, one, one, "candidate_expansion"),
            _range(spoken, F.col("start_line"), F.coalesce("end_line", "start_line"), "symbol"),
            _range(related.join(lengths, "path"), one, F.col("length"), "related_expansion"),
            _range(itself, one, end, "file_expansion"),
            _range(around, F.greatest(one, F.col("start") - more), F.col("end") + more, "expanded_surroundings"),
        ],
    ).distinct()


def still_valid(held: DataFrame, files: DataFrame) -> DataFrame:
    """held (..., path, sha256) with status: CURRENT, SOURCE_CHANGED, or SOURCE_REMOVED; files have path and sha256."""
    now = files.select("path", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "SOURCE_REMOVED").when(F.col("now") == F.col("sha256"), "CURRENT").otherwise("SOURCE_CHANGED")
    return held.join(now, "path", "left").withColumn("status", status).drop("now")


def unsent(ranges: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of ranges (keys, start, end) that no range of sent has; ranges of a key may overlap and touch."""
    asked = intervals.merge(ranges.select(*keys, "start", "end"), keys).drop("n_merged")
    marks = asked.select(*keys, "start", "end", F.lit(False).alias("sent")).unionByName(
        intervals.merge(sent.select(*keys, "start", "end"), keys).select(*keys, "start", "end", F.lit(True).alias("sent"))
    )
    # Both sides are disjoint, so between two neighbouring edges of ranges nothing changes.
    edges = marks.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.when(F.col("sent"), 0).otherwise(1).alias("asked"), F.when(F.col("sent"), 1).otherwise(0).alias("had")),
        F.struct((F.col("end") + 1).alias("at"), F.when(F.col("sent"), 0).otherwise(-1).alias("asked"), F.when(F.col("sent"), -1).otherwise(0).alias("had")),
    )).alias("edge"))
    steps = edges.groupBy(*keys, "edge.at").agg(F.sum("edge.asked").alias("asked"), F.sum("edge.had").alias("had"))
    order = Window.partitionBy(*keys).orderBy("at")
    running = steps.select(
        *keys, F.col("at").alias("start"), (F.lead("at").over(order) - 1).alias("end"),
        F.sum("asked").over(order).alias("asked"), F.sum("had").over(order).alias("had"),
    )
    return intervals.merge(running.where("asked > 0 and had = 0"), keys).drop("n_merged")


def expand(
    held: DataFrame, requests: DataFrame, ranked: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame,
    budget: int, generation: int,
) -> tuple[DataFrame, DataFrame]:
    """The next pack and what it sends.

    held: taken ranges of earlier generations (query_id, path, start, end, priority, sha256). Those of unchanged files
    are in the next pack too, whatever the budget; those of changed or removed files are no longer counted as sent. The
    pack is that of `packing.pack`, with sha256 and generation. Sent are (query_id, path, start, end, excerpt, sha256,
    generation): its lines that no earlier generation has sent from the same content. Queries without a request get
    the same treatment with nothing asked for. files: (path, text, line_count, sha256, and is_test if there is one).
    """
    valid = still_valid(held, files).where("status = 'CURRENT'")
    wanted = requested(requests, held, ranked, symbols, files, edges)
    forced = valid.select(*RANGE).unionByName(wanted.select(*RANGE))
    digests = files.select("path", "sha256")
    number = F.lit(generation).cast("int").alias("generation")
    packed = packing.pack(ranked, symbols, files, budget, edges=edges, forced=forced).join(digests, "path").select("*", number)
    fresh = unsent(packed.where("taken"), valid, KEYS)
    lines = files.select("path", "sha256", T.split_lines("text").alias("lines"))
    body = F.array_join(F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    sent = fresh.join(lines, "path").select(*RANGE, T.redacted(body).alias("excerpt"), "sha256", number)
    return packed, sent
