"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are sorted by that key in
ranges of the key space, which are even because the keys are random; a range's total and the
totals of the ranges before it give each document its place in the source's running word count
without one task seeing a whole source. The order is cut at the source's budget: whole epochs
first, then a prefix of the order, whose last document is cut at the exact word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: A window sorts one range of one source: ranges are so many that all rows would fill each with RANGE_ROWS.
RANGE_ROWS, MOST_RANGE_BITS = 4096, 20
KEY_BITS = 60


def random_key(seed: int) -> Column:
    """60 hash-random bits of the doc_id, equal in every run."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def with_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Source i by code point, nulls last, gets weights[i mod their number].

    One row per source is ordered here, never documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def with_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Share the sum of source_size by weight; no target passes max_epochs times its source.

    The excess of a source at its limit is shared anew by weight among the others. Sources reach
    their limits in the order of limit / weight, so the ones at the limit are a prefix of that
    order: those whose share of what the earlier ones leave is no less than their limit.
    """
    limit = F.col("source_size") * max_epochs
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    marked = sources.select(
        "*",
        limit.alias("limit"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), zero)).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).alias("weight_left"),
    )
    full = F.col("left") * F.col("weight") >= F.col("limit") * F.col("weight_left")
    open_at = F.first(F.when(~full, F.struct("left", "weight_left")), ignorenulls=True)
    return marked.withColumn("open", open_at.over(order)).select(
        "name",
        "source_size",
        F.when(F.col("open").isNull(), F.col("limit").cast("double"))
        .otherwise((F.col("open.left") * F.col("weight")).cast("double") / F.col("open.weight_left"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """All rows of docs as struct __row with size, source_size, target and taken.

    size counts words; a null text has none. A null source is a source of its own. A null doc_id
    has a key like any other; rows with equal keys are ordered by doc_id and size, so repeated
    rows are counted one by one. The sum of taken is the floor of the target in each source; an
    empty table gives no rows. Columns of docs may have any names.
    """
    bits = min(MOST_RANGE_BITS, max(4, math.ceil(math.log2(1 + docs.count() / range_rows))))
    # A source and its absence by a name that is never null, so that window and joins share one partitioning.
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    sized = docs.select(
        F.struct("*").alias("__row"),
        F.col("doc_id").alias("doc_id"),
        F.col("source").alias("source"),
        name.alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        random_key(seed).alias("key"),
    ).withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = sized.groupBy("name", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    totals = sums.groupBy("name").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    targets = with_targets(with_weights(totals, weights), max_epochs)
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("name", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    placed = offsets.join(targets.select("name", "source_size", "target"), "name")
    inside = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = sized.withColumn("through", running).join(placed, ["name", "range"])
    through = F.col("offset") + F.col("through")
    return summed.select("__row", "size", "source_size", "target", taken(through).cast("long").alias("taken"))


def taken(through: Column) -> Column:
    """Words taken of a document that ends the running count through: whole epochs, and its part of the last one."""
    size, source_size = F.col("size"), F.col("source_size")
    budget = F.floor("target")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0)
    rest = budget - epochs * source_size
    return epochs * size + F.greatest(F.lit(0), F.least(size, rest - (through - size)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken; the document that the budget cuts comes whole.

    A document without words has nothing to take and stays once.
    """
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    repeated = mix(docs, **options).select("__row", copies.alias("copies")).where("copies > 0")
    return repeated.select("__row", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; a null text has size 0, and null sources are one source."""
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("__row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 15))::BIGINT AS key
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
left_over AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::BIGINT AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::BIGINT AS rest_weight
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (
  SELECT min(cap / weight) AS first_open FROM left_over WHERE rest * weight < cap * rest_weight),
share AS (
  SELECT max(rest) AS rest, max(rest_weight) AS rest_weight FROM left_over, opened WHERE cap / weight >= first_open),
targets AS (
  SELECT source, source_size,
         CASE WHEN rest * weight >= cap * rest_weight THEN cap::DOUBLE
              ELSE ((SELECT rest FROM share) * weight)::DOUBLE / (SELECT rest_weight FROM share) END AS target
  FROM left_over),
summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id) AS through
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size ELSE 0 END
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - (through - size))))::BIGINT AS taken
FROM summed
"""
