"""Statistics over long tables of (group, feature, value), and comparisons of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def percentiles(rows: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; null for a group without values.

    Equal values are counted where they are read, so a group's task holds each distinct value once,
    and all percentiles come from one such table.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    found = counted.groupBy(*keys).agg(_percentiles(value, named.values(), F.col("__n")).alias("__found"))
    return found.select(*keys, *[F.col("__found")[i].alias(n) for i, n in enumerate(named)])


def _percentiles(value: str, shares, times):
    return F.percentile(value, F.array(*map(F.lit, shares)), times)


def long_format(rows: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return rows.select(*ids, pairs.alias("pair")).select(*ids, "pair.*")


def distributions(rows: DataFrame, features: list[str]) -> DataFrame:
    """Least, quartiles and greatest of every feature."""
    counted = long_format(rows, [], features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    found = counted.groupBy("feature").agg(
        F.min("value").alias("least"), _percentiles("value", (0.25, 0.5, 0.75), F.col("n")).alias("q"), F.max("value").alias("greatest")
    )
    return found.select("feature", "least", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))], "greatest")


def positions(rows: DataFrame, anchors: DataFrame, features: list[str]) -> DataFrame:
    """How many rows lie below, at and above each anchor's value (anchor, feature, anchor_value)."""
    values = long_format(rows, [], features).groupBy("feature", "value").count()
    joined = values.join(anchors, "feature")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias
    here, there = F.col("value"), F.col("anchor_value")
    return joined.groupBy("anchor", "feature", "anchor_value").agg(
        count(here < there)("n_below"), count(here == there)("n_equal"), count(here > there)("n_above")
    )


def compare(cases: DataFrame, case: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Every other case's metrics against the baseline's: difference and percent; a metric missing on a side is left out."""
    long = long_format(cases, [case], metrics)
    base = long.where(F.col(case) == baseline).select("feature", F.col("value").alias("base"))
    other = long.where(F.col(case) != baseline)
    return other.join(base, "feature").where("base is not null and value is not null").select(
        case,
        F.col("feature").alias("metric"),
        "base",
        "value",
        (F.col("value") - F.col("base")).alias("delta"),
        numbers.percent_change("base", "value").alias("percent"),
    )
