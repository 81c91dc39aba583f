"""Sequence queries over the event log and conversations, streaming ones included."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import telemetry, windows
from ..sources.tables import table
from ..streaming import ledger

_US = "epoch_us(ts)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("us", F.unix_micros("ts"))


def inter_event_gaps(spark: SparkSession, sf: str) -> DataFrame:
    found = windows.gaps(_events(spark, sf), ["user_id"], "us", ["us", "event_id"])
    return found.select("event_id", "user_id", F.col("gap").cast("double").alias("gap_us"))


GAPS = f"SELECT event_id, user_id, ({_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY {_US}, event_id))::DOUBLE AS gap_us FROM events"


def cumulative_progress(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").withColumn("tokens", F.floor((F.octet_length("text") + 3) / 4).cast("long"))
    return windows.running_total(talk, ["conv_id"], "tokens", ["turn"]).select("conv_id", "turn", "tokens", F.col("running").alias("so_far"))


PROGRESS = """
SELECT conv_id, turn, (strlen(text) + 3) // 4 AS tokens,
       sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS so_far FROM conversations
"""


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = windows.runs(_events(spark, sf), ["user_id"], "event_type", ["us", "event_id"])
    return runs.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"), F.sum("length").alias("n_events"))


RUNS = f"""
WITH m AS (SELECT user_id, event_type, event_id, {_US} AS us, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS starts
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_US}, event_id)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM m),
r AS (SELECT user_id, run, event_type, count(*) AS length FROM n GROUP BY ALL)
SELECT event_type, count(*) AS n_runs, max(length) AS longest, sum(length)::BIGINT AS n_events FROM r GROUP BY event_type
"""


def first_seen_flags(spark: SparkSession, sf: str) -> DataFrame:
    seen = windows.seen_before(_events(spark, sf), ["user_id"], "event_type", ["us", "event_id"])
    return seen.select("event_id", "seen_before")


SEEN = f"SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_US}, event_id) > 1 AS seen_before FROM events"


def ledger_before_after(spark: SparkSession, sf: str) -> DataFrame:
    found = windows.ledger(_events(spark, sf), ["user_id"], "event_type", ["us", "event_id"])
    return found.select("event_id", "known_before", "known_after")


LEDGER = f"""
WITH s AS (SELECT event_id, user_id, {_US} AS us,
                  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_US}, event_id) = 1 THEN 1 ELSE 0 END AS adds FROM events)
SELECT event_id, (sum(adds) OVER w - adds)::BIGINT AS known_before, (sum(adds) OVER w)::BIGINT AS known_after
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
"""


def simultaneous_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring events of one day as one group."""
    days = _events(spark, sf).withColumn("day", F.to_date("ts"))
    runs = windows.runs(days, ["user_id"], "day", ["us", "event_id"])
    return runs.groupBy("user_id").agg(F.count("*").alias("n_groups"), F.max("length").alias("largest"))


GROUPS = """
SELECT user_id, count(*) AS n_groups, max(n) AS largest FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
"""


def round_robin_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Forty line items of each supplier, rank by rank over its parts' return flags."""
    items = table(spark, sf, "lineitem")
    found = windows.round_robin(items, ["l_returnflag"], ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 40)
    return found.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("turn").cast("long").alias("last_turn"))


ROUND_ROBIN = """
WITH t AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS turn FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY turn, l_returnflag) AS place FROM t)
SELECT l_suppkey, l_returnflag, count(*) AS n, max(turn) AS last_turn FROM p WHERE place <= 40 GROUP BY ALL
"""


def first_fit_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of each order taken in order of price while their quantities fit 100; the others are skipped."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("cost"), "l_extendedprice")
    return windows.first_fit(items, ["l_orderkey"], "cost", ["l_extendedprice", "l_linenumber"], 100).select(
        "l_orderkey", "l_linenumber", "taken", "used"
    )


#: At most seven rows an order, so a recursion of seven steps says the same.
FIRST_FIT = """
WITH RECURSIVE o AS (
  SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS n FROM lineitem),
f AS (
  SELECT l_orderkey, l_linenumber, n, cost <= 100 AS taken, CASE WHEN cost <= 100 THEN cost ELSE 0 END AS used FROM o WHERE n = 1
  UNION ALL
  SELECT o.l_orderkey, o.l_linenumber, o.n, f.used + cost <= 100, CASE WHEN f.used + cost <= 100 THEN f.used + cost ELSE f.used END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
SELECT l_orderkey, l_linenumber, taken, used FROM f
"""


def last_event_fold(spark: SparkSession, sf: str) -> DataFrame:
    """For each user the last value wins, counters add up."""
    events = _events(spark, sf)
    at = F.struct("us", "event_id")
    bought = F.col("event_type") == "purchase"
    return events.groupBy("user_id").agg(
        F.max_by("event_type", at).alias("last_type"),
        F.max_by(F.when(bought, F.col("value")), F.when(bought, at)).alias("last_purchase"),
        F.count_if(bought).alias("n_purchases"),
        F.count("*").alias("n_events"),
    )


FOLD = f"""
SELECT user_id, max_by(event_type, ({_US}, event_id)) AS last_type,
       max_by(value, ({_US}, event_id)) FILTER (event_type = 'purchase') AS last_purchase,
       count(*) FILTER (event_type = 'purchase') AS n_purchases, count(*) AS n_events
FROM events GROUP BY user_id
"""


def json_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = numbers.json_count("props", "$.k")
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("k").alias("n_valid"), F.sum("k").alias("total"), F.max("k").alias("most")
    )


JSON_COUNTS = """
WITH e AS (SELECT event_type, CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9]{1,18}') THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events)
SELECT event_type, count(*) AS n, count(k) AS n_valid, sum(k)::BIGINT AS total, max(k) AS most FROM e GROUP BY event_type
"""


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by tool with a row for all, events as calls and errors as failures."""
    events = table(spark, sf, "events")
    entries = events.select(
        F.pmod("user_id", F.lit(7)).cast("string").alias("tool"),
        (F.col("event_type") != "error").alias("success"),
        numbers.json_count("props", "$.k").alias("tokens"),
    )
    return telemetry.usage_summary(entries, ["tokens"])


USAGE = """
SELECT (user_id % 7)::VARCHAR AS tool, count(*) AS n_calls, count(*) FILTER (event_type <> 'error') AS n_success,
       count(*) FILTER (event_type = 'error') AS n_errors, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens
FROM events GROUP BY ROLLUP ((user_id % 7)::VARCHAR)
"""


def reread_counts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.rereads(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


REREADS = """
SELECT l_suppkey, sum(n)::BIGINT AS n_reads, count(*) AS n_unique, sum(n - 1)::BIGINT AS n_rereads
FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey
"""


def pair_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Users' first and second half of events as a pair of runs."""
    e = _events(spark, sf).withColumn("arm", F.when(F.dayofmonth("ts") <= 15, "base").otherwise("opt"))
    side = lambda arm, kind: F.count_if((F.col("arm") == arm) & (F.col("event_type") == kind))
    pairs = e.groupBy("user_id").agg(
        (side("base", "signup") + side("opt", "signup") > 0).alias("valid"),
        (side("base", "error") < side("base", "purchase")).alias("base_correct"),
        (side("opt", "error") < side("opt", "purchase")).alias("correct"),
        side("base", "view").alias("base_reads"),
        side("opt", "view").alias("reads"),
        side("base", "click").alias("base_searches"),
        side("opt", "click").alias("searches"),
    )
    return pairs.select("user_id", telemetry.pair_verdict().alias("verdict"))


PAIRS = """
WITH e AS (SELECT user_id, event_type, day(ts) <= 15 AS base FROM events),
p AS (SELECT user_id, count(*) FILTER (event_type = 'signup') > 0 AS valid,
  count(*) FILTER (base AND event_type = 'error') < count(*) FILTER (base AND event_type = 'purchase') AS base_correct,
  count(*) FILTER (NOT base AND event_type = 'error') < count(*) FILTER (NOT base AND event_type = 'purchase') AS correct,
  count(*) FILTER (base AND event_type = 'view') AS base_reads, count(*) FILTER (NOT base AND event_type = 'view') AS reads,
  count(*) FILTER (base AND event_type = 'click') AS base_searches, count(*) FILTER (NOT base AND event_type = 'click') AS searches
  FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN NOT valid THEN 'INVALID_INFRASTRUCTURE' WHEN base_correct AND NOT correct THEN 'CORRECTNESS_REGRESSION'
  WHEN NOT correct THEN 'TASK_FAILURE' WHEN reads < base_reads OR searches < base_searches THEN 'CORRECT_WITH_LESS_NATIVE_EXPLORATION'
  ELSE 'CORRECT_NO_MEASURED_EXPLORATION_REDUCTION' END AS verdict FROM p
"""


def area_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks, ship modes by supplier third as areas, suppliers as options, line items as references."""
    items = table(spark, sf, "lineitem")
    rows = items.select(
        F.col("l_suppkey").alias("task"), F.col("l_linestatus").alias("area"), F.col("l_linenumber").alias("option"),
        (F.col("l_quantity") < 45).alias("satisfied"),
    )
    return telemetry.area_coverage(rows)


AREAS = """
WITH o AS (SELECT l_suppkey AS task, l_linestatus AS area, l_linenumber AS option, bool_and(l_quantity < 45) AS whole, bool_or(l_quantity < 45) AS part
           FROM lineitem GROUP BY ALL)
SELECT task, area, bool_or(whole) AS "full", bool_or(part) AND NOT bool_or(whole) AS partial FROM o GROUP BY task, area
"""


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='streams-')}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    whole = spark.read.parquet(f"{sf}/{name}.parquet")
    folder, _, file = whole.inputFiles()[0].rpartition("/")
    glob = f"{name}.parquet" if file == f"{name}.parquet" else "*.parquet"
    return spark.readStream.schema(whole.schema).option("pathGlobFilter", glob).parquet(folder)


def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts by kind from a stream that is run to its end; the last day closes with the log."""
    stream = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"))
    name = f"w{uuid.uuid4().hex}"
    query = (
        counts.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


STREAM_WINDOWS = """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_large FROM events GROUP BY ALL
"""


def stream_first_events(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (user, kind) of the stream, remembered within the watermark."""
    stream = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = ledger.first_events(stream, ["user_id", "event_type"], "400 days").select("user_id", "event_type")
    return ledger.run_to_table(first, spark, _folder(spark))


STREAM_FIRST = "SELECT DISTINCT user_id, event_type FROM events"

PLANS = {
    "inter_event_gaps": (inter_event_gaps, GAPS),
    "cumulative_progress": (cumulative_progress, PROGRESS),
    "event_runs": (event_runs, RUNS),
    "first_seen_flags": (first_seen_flags, SEEN),
    "ledger_before_after": (ledger_before_after, LEDGER),
    "simultaneous_groups": (simultaneous_groups, GROUPS),
    "round_robin_allocation": (round_robin_allocation, ROUND_ROBIN),
    "first_fit_budget": (first_fit_budget, FIRST_FIT),
    "last_event_fold": (last_event_fold, FOLD),
    "json_counts": (json_counts, JSON_COUNTS),
    "usage_summary": (usage_summary, USAGE),
    "reread_counts": (reread_counts, REREADS),
    "pair_verdicts": (pair_verdicts, PAIRS),
    "area_coverage": (area_coverage, AREAS),
    "stream_event_windows": (stream_event_windows, STREAM_WINDOWS),
    "stream_first_events": (stream_first_events, STREAM_FIRST),
}
