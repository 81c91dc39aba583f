"""Interval queries: line items as ranges of their part's positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, telemetry
from ..operators.storage import spread
from ..sources.tables import table


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier, from the day of shipping so many days as the quantity says."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    items = table(spark, sf, "lineitem")
    return items.select(F.col("l_suppkey").alias("key"), day.alias("start"), (day + F.col("l_quantity").cast("long") - 1).alias("end"))


_RANGES = """
WITH ranges AS (
  SELECT l_suppkey AS key, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS "start",
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT - 1 AS "end" FROM lineitem),
opened AS (
  SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3
                 THEN 0 ELSE 1 END AS opens FROM ranges),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY "start", "end") AS island FROM opened),
merged AS (SELECT key, min("start") AS "start", max("end") AS "end", count(*) AS n_merged FROM islands GROUP BY key, island)
"""


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(_ranges(spark, sf), ["key"], gap=2)


INTERVAL_MERGE = _RANGES + 'SELECT key, "start", "end", n_merged FROM merged'


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier, all days between the shipping of 1993 and of 1997."""
    first, last = F.lit(8401).cast("long"), F.lit(10226).cast("long")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), first.alias("first"), last.alias("last"))


_BOUNDS = ", bounds AS (SELECT s_suppkey AS key, 8401::BIGINT AS first, 10226::BIGINT AS last FROM supplier)"


def interval_complement(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.complement(interval_merge(spark, sf), _bounds(spark, sf), ["key"])


INTERVAL_COMPLEMENT = _RANGES + _BOUNDS + """,
days AS (SELECT key, unnest(range(first, last + 1)) AS day FROM bounds),
free AS (SELECT d.key, d.day FROM days d ANTI JOIN merged m ON d.key = m.key AND d.day BETWEEN m."start" AND m."end"),
runs AS (SELECT key, day, day - row_number() OVER (PARTITION BY key ORDER BY day) AS run FROM free)
SELECT key, min(day) AS gap_start, max(day) AS gap_end FROM runs GROUP BY key, run
"""


def interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.covered(interval_merge(spark, sf), _bounds(spark, sf), ["key"])


INTERVAL_COVERAGE = _RANGES + _BOUNDS + """,
counted AS (
  SELECT b.key, first, last, coalesce(sum(greatest(0, least("end", last) - greatest("start", first) + 1)), 0)::BIGINT AS n_covered
  FROM bounds b LEFT JOIN merged m ON b.key = m.key GROUP BY b.key, first, last)
SELECT *, CASE WHEN n_covered >= last - first + 1 THEN 'FULL' WHEN n_covered > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM counted
"""


def full_file_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files of seven lines, their line items as ranges of one."""
    items = table(spark, sf, "lineitem")
    lines = items.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("start"))
    lines = spread(lines, items.count(), "key")
    ranges = lines.distinct().withColumn("end", F.col("start"))
    lengths = lines.groupBy("key").agg((F.max("start") + 1).alias("length"))
    return intervals.promoted(intervals.merge(ranges, ["key"]), lengths, ["key"])


FULL_FILE = """
WITH lines AS (SELECT DISTINCT l_orderkey AS key, l_linenumber::BIGINT AS line FROM lineitem),
lengths AS (SELECT key, max(line) + 1 AS length, count(*) AS total FROM lines GROUP BY key),
runs AS (SELECT key, line, line - row_number() OVER (PARTITION BY key ORDER BY line) AS run FROM lines),
merged AS (SELECT key, min(line) AS "start", max(line) AS "end" FROM runs GROUP BY key, run)
SELECT DISTINCT key, CASE WHEN total >= length * 0.75 THEN 1 ELSE "start" END AS "start",
       CASE WHEN total >= length * 0.75 THEN length ELSE "end" END AS "end",
       CASE WHEN total >= length * 0.75 THEN 'full_file' ELSE 'range' END AS kind
FROM merged JOIN lengths USING (key)
"""


def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Returned line items and the other line items of the same part whose days overlap."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    items = table(spark, sf, "lineitem").withColumn("first", day).withColumn("last", day + F.col("l_quantity").cast("long") - 1)
    left = items.where("l_returnflag = 'R'").select("l_partkey", "l_orderkey", F.col("first").alias("l_start"), F.col("last").alias("l_end"))
    right = items.where("l_returnflag <> 'R'").select("l_partkey", F.col("first").alias("r_start"), F.col("last").alias("r_end"))
    found = intervals.overlap_join(left, right, ["l_partkey"], 32)
    return found.groupBy("l_partkey").agg(
        F.count("*").alias("n_pairs"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("n_days")
    )


OVERLAP_JOIN = """
WITH d AS (SELECT l_partkey, l_returnflag, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS a,
                  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT - 1 AS b FROM lineitem)
SELECT l.l_partkey, count(*) AS n_pairs, sum(least(l.b, r.b) - greatest(l.a, r.a) + 1)::BIGINT AS n_days
FROM d l JOIN d r ON l.l_partkey = r.l_partkey AND l.l_returnflag = 'R' AND r.l_returnflag <> 'R' AND l.a <= r.b AND l.b >= r.a
GROUP BY l.l_partkey
"""


def innermost_range(spark: SparkSession, sf: str) -> DataFrame:
    """For each order, the shortest of its supplier ranges that holds the order's own day."""
    ordered = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_date(F.to_date("o_orderdate")).alias("day"))
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", (day - 60).alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), F.concat(F.lit("line"), "l_linenumber").alias("name")
    )
    pairs = items.join(ordered, "l_orderkey").where("day between start and end")
    return intervals.innermost(pairs, ["l_orderkey"], "start", "end", "name")


INNERMOST = """
WITH p AS (
  SELECT l_orderkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) - 60 AS "start",
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS "end", 'line' || l_linenumber AS name,
         date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, name, "start", "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY "end" - "start", name, "start") AS n FROM p WHERE day BETWEEN "start" AND "end")
WHERE n = 1
"""


def delivery_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as deliveries of supplier ranges to customers: days new to the supplier's ledger, and days known."""
    found = intervals.delivered(_ranges(spark, sf), ["key"])
    return found.select("key", F.col("n_unique").alias("unique_bytes"), F.col("n_repeated").alias("repeated_bytes"))


DELIVERY_OVERLAP = """
WITH lines AS (
  SELECT l_suppkey AS key, unnest(range(date_diff('day', DATE '1970-01-01', l_shipdate::DATE),
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT)) AS line FROM lineitem)
SELECT key, count(DISTINCT line) AS unique_bytes, count(*) - count(DISTINCT line) AS repeated_bytes FROM lines GROUP BY key
"""

def read_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files of p_size lines, their suppliers as runs that read them; line items, unless returned, as what was delivered."""
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    files = part.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("line_count"))
    line = F.col("l_linenumber").cast("long")
    deliveries = items.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("path"), line.alias("start"),
        (line + F.col("l_quantity").cast("long") - 1).alias("end"), (F.col("l_returnflag") != "R").alias("success"),
    )
    deliveries = spread(deliveries, items.count(), "run_id", "path")
    return telemetry.read_coverage(deliveries.select("run_id", "path").distinct(), deliveries, files)


READ_COVERAGE = f"""
WITH reads AS (SELECT DISTINCT l_suppkey AS run_id, l_partkey AS path FROM lineitem),
lines AS (SELECT DISTINCT l_suppkey AS run_id, l_partkey AS path, unnest(range(l_linenumber, l_linenumber + l_quantity::BIGINT)) AS line
          FROM lineitem WHERE l_returnflag <> 'R'),
counted AS (SELECT run_id, path, p_size, count(*) FILTER (line <= p_size) AS n FROM lines JOIN part ON p_partkey = path GROUP BY ALL)
SELECT run_id, path, CASE WHEN n IS NULL THEN '{telemetry.ABSENT}' WHEN n >= p_size THEN '{telemetry.COMPLETE}' ELSE '{telemetry.PARTIAL}' END AS coverage
FROM reads LEFT JOIN counted USING (run_id, path)
"""


def samples_at_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the last line item that was shipped on the order's very day."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    samples = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return telemetry.samples_at(orders, samples, "day", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_quantity"]).drop("day")


SAMPLES_AT = """
WITH last AS (SELECT l_shipdate::DATE AS day, max((l_orderkey, l_linenumber, l_quantity)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, s[1] AS l_orderkey, s[2] AS l_linenumber, s[3] AS l_quantity FROM orders LEFT JOIN last ON day = o_orderdate::DATE
"""

PLANS = {
    "read_coverage": (read_coverage, READ_COVERAGE),
    "samples_at_events": (samples_at_events, SAMPLES_AT),
    "interval_merge": (interval_merge, INTERVAL_MERGE),
    "interval_complement": (interval_complement, INTERVAL_COMPLEMENT),
    "interval_coverage": (interval_coverage, INTERVAL_COVERAGE),
    "full_file_promotion": (full_file_promotion, FULL_FILE),
    "interval_overlap_join": (interval_overlap_join, OVERLAP_JOIN),
    "innermost_range": (innermost_range, INNERMOST),
    "delivery_overlap": (delivery_overlap, DELIVERY_OVERLAP),
}
