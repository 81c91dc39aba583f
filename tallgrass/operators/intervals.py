"""Operators on closed integer intervals [start, end], grouped by key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, keys: list[str], gap: int = 0, any_of: list[str] | None = None) -> DataFrame:
    """Intervals of a key that overlap, or lie at most gap apart, become one; n_merged counts its members.

    A column of any_of is true if it is for any of them.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach + gap + 1, 0).otherwise(1)
    island = ranges.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    return island.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"),
        *(F.bool_or(c).alias(c) for c in any_of or []),
    ).drop("island")


def complement(merged: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of bounds (keys, first, last) that merged, disjoint intervals leave out."""
    inside = bounds.join(merged.select(*keys, "start", "end"), keys, "left")
    clipped = inside.where("start is null or (end >= first and start <= last)")
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.coalesce(F.lag("end").over(order) + 1, F.col("first"))
    gaps = clipped.select(*keys, before.alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    tails = clipped.groupBy(*keys, "first", "last").agg(F.max("end").alias("end"))
    tails = tails.select(*keys, F.coalesce(F.col("end") + 1, "first").alias("gap_start"), F.col("last").alias("gap_end"))
    untouched = bounds.join(clipped.select(*keys).distinct(), keys, "left_anti")
    untouched = untouched.select(*keys, F.col("first").alias("gap_start"), F.col("last").alias("gap_end"))
    return gaps.union(tails).union(untouched).where("gap_start <= gap_end")


def covered(merged: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """bounds (keys, first, last) with the lines covered and FULL, PARTIAL or MISSING."""
    inside = F.greatest(F.lit(0), F.least("end", "last") - F.greatest("start", "first") + 1)
    overlap = F.when(F.col("start").isNotNull(), inside)  # greatest() would pass over a null start
    joined = bounds.join(merged.select(*keys, "start", "end"), keys, "left")
    counted = joined.groupBy(*keys, "first", "last").agg(F.coalesce(F.sum(overlap), F.lit(0)).cast("long").alias("n_covered"))
    size = F.col("last") - F.col("first") + 1
    status = F.when(F.col("n_covered") >= size, "FULL").when(F.col("n_covered") > 0, "PARTIAL").otherwise("MISSING")
    return counted.withColumn("status", status)


def promoted(merged: DataFrame, lengths: DataFrame, keys: list[str], share: float = 0.75, any_of: list[str] | None = None) -> DataFrame:
    """Merged ranges of a key; where they cover share of its length or more, the whole of it instead.

    A column of any_of is true for the whole if it is for any range.
    """
    of_key = Window.partitionBy(*keys)
    total = F.sum(F.col("end") - F.col("start") + 1).over(of_key)
    anywhere = {f"any_{c}": F.bool_or(c).over(of_key) for c in any_of or []}
    marked = merged.select(*keys, "start", "end", *(any_of or [])).withColumn("total", total).withColumns(anywhere).join(lengths, keys)
    whole = F.col("total") >= F.col("length") * share
    return marked.select(
        *keys,
        F.when(whole, F.lit(1)).otherwise(F.col("start")).cast("long").alias("start"),
        F.when(whole, F.col("length")).otherwise(F.col("end")).cast("long").alias("end"),
        F.when(whole, "full_file").otherwise("range").alias("kind"),
        *(F.when(whole, F.col(f"any_{c}")).otherwise(F.col(c)).alias(c) for c in any_of or []),
    ).distinct()


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Pairs of intervals (l_start, l_end) and (r_start, r_end) of one key that overlap.

    Both sides are spread over bins of bin_size, so the join is by equality; a pair that shares
    several bins is kept in the first of them. bin_size should be about a usual interval's length.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    joined = left.withColumn("bin", bins("l_start", "l_end")).join(right.withColumn("bin", bins("r_start", "r_end")), [*keys, "bin"])
    first = F.floor(F.greatest("l_start", "r_start") / bin_size)
    return joined.where("l_start <= r_end and l_end >= r_start").where(F.col("bin") == first).drop("bin")


def innermost(pairs: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Of the intervals paired with each key, the shortest; of equal ones the first by name (null last), then by start."""
    order = F.struct(F.col(end) - F.col(start), F.col(name).isNull(), F.col(name), F.col(start))
    best = F.min_by(F.struct(name, start, end), order)
    return pairs.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def delivered(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """For each key how many places its ranges cover, and how many times more they cover them again."""
    merged = merge(ranges, keys).select(*keys, (F.col("end") - F.col("start") + 1).alias("unique"), F.lit(0).cast("long").alias("total"))
    each = ranges.select(*keys, F.lit(0).cast("long").alias("unique"), (F.col("end") - F.col("start") + 1).alias("total"))
    sums = merged.unionByName(each).groupBy(*keys).agg(F.sum("unique").alias("n_unique"), F.sum("total").alias("n_total"))
    return sums.select(*keys, "n_unique", (F.col("n_total") - F.col("n_unique")).alias("n_repeated"))
