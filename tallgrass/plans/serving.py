"""Analytics of serving requests: conversations as requests, their turns as steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import serving, stats
from ..sources.tables import table

BLOCK = 16


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("tokens", F.floor((F.octet_length("text") + 3) / 4).cast("long"))


_TOKENS = "WITH t AS (SELECT *, (strlen(text) + 3) // 4 AS tokens FROM conversations)"


def request_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Memory blocks of a request, and the prompt tokens in whole blocks that a prefix cache could keep."""
    t = _tokens(spark, sf)
    spoken = F.col("role") == "assistant"
    r = t.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(~spoken, F.col("tokens"))), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(spoken, F.col("tokens"))), F.lit(0)).cast("long").alias("output_tokens"),
    )
    whole = F.col("prompt_tokens") + F.col("output_tokens")
    return r.select("*", numbers.blocks(whole, BLOCK).alias("n_blocks"), numbers.whole_blocks("prompt_tokens", BLOCK).alias("cacheable"))


REQUEST_BLOCKS = _TOKENS + """,
r AS (SELECT conv_id, coalesce(sum(tokens) FILTER (role <> 'assistant'), 0)::BIGINT AS prompt_tokens,
             coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS output_tokens FROM t GROUP BY conv_id)
SELECT *, (prompt_tokens + output_tokens + 15) // 16 AS n_blocks, prompt_tokens // 16 * 16 AS cacheable FROM r
"""


def prefix_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that open with the same turn: the first of them misses, the others reuse its whole blocks."""
    first = _tokens(spark, sf).groupBy("conv_id").agg(F.min_by(F.struct("text", "tokens"), "turn").alias("head"))
    keyed = first.select("conv_id", F.sha2("head.text", 256).alias("prefix_key"), F.col("head.tokens").alias("tokens"))
    group = keyed.groupBy("prefix_key").agg(
        F.count("*").alias("n_requests"), (F.count("*") - 1).alias("n_hits"), F.max(numbers.whole_blocks("tokens", BLOCK)).alias("shared")
    )
    return group.select("prefix_key", "n_requests", "n_hits", (F.col("n_hits") * F.col("shared")).alias("reused_tokens"))


PREFIX_REUSE = _TOKENS + """,
f AS (SELECT conv_id, min_by(text, turn) AS head FROM t GROUP BY conv_id)
SELECT sha256(head) AS prefix_key, count(*) AS n_requests, count(*) - 1 AS n_hits,
       (count(*) - 1) * max((strlen(head) + 3) // 4 // 16 * 16) AS reused_tokens FROM f GROUP BY sha256(head)
"""


def step_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds of each turn's batch over all conversations that reach it."""
    t = _tokens(spark, sf)
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spoken = F.col("role") == "assistant"
    steps = t.withColumn("context", before).groupBy("turn").agg(
        F.coalesce(F.sum(F.when(~spoken, F.col("tokens"))), F.lit(0)).alias("prefill_tokens"),
        F.coalesce(F.sum(F.when(spoken, F.col("tokens"))), F.lit(0)).alias("decode_tokens"),
        F.count("*").alias("members"),
        F.sum("context").alias("context_tokens"),
    )
    cost = numbers.batch_cost("prefill_tokens", "decode_tokens", "members", "context_tokens")
    return steps.withColumn("cost_ms", F.round(cost, 6))


STEP_COSTS = _TOKENS + """,
c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context FROM t),
s AS (SELECT turn, coalesce(sum(tokens) FILTER (role <> 'assistant'), 0)::BIGINT AS prefill_tokens,
             coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS decode_tokens, count(*) AS members, sum(context)::BIGINT AS context_tokens
      FROM c GROUP BY turn)
SELECT *, round((CASE WHEN prefill_tokens > 0 THEN 1.0::DOUBLE + prefill_tokens * 0.08::DOUBLE ELSE 0 END
                 + CASE WHEN decode_tokens > 0 THEN 0.6::DOUBLE + decode_tokens * 0.22::DOUBLE ELSE 0 END)
                * (1 - least(0.7::DOUBLE, (members - 1) * 0.08::DOUBLE)) + context_tokens * 0.002::DOUBLE, 6) AS cost_ms FROM s
"""


def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Users' days as requests: time to the first click, to the last event, and the mean gap between events."""
    e = table(spark, sf, "events").withColumn("us", F.unix_micros("ts")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    clicked = F.min(F.when(F.col("event_type") == "click", F.col("us")))
    r = e.groupBy("user_id", "day").agg(F.min("us").alias("arrival"), clicked.alias("first_token"), F.max("us").alias("completion"), F.count("*").alias("n"))
    return r.select(
        "user_id", "day",
        (F.col("first_token") - F.col("arrival")).cast("double").alias("ttft_us"),
        (F.col("completion") - F.col("arrival")).alias("e2e_us"),
        F.when(F.col("n") > 1, (F.col("completion") - F.col("arrival")) / (F.col("n") - 1)).alias("itl_us"),
    )


REQUEST_METRICS = """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS us, event_type FROM events),
r AS (SELECT user_id, day, min(us) AS arrival, min(us) FILTER (event_type = 'click') AS first_token, max(us) AS completion, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, day, (first_token - arrival)::DOUBLE AS ttft_us, completion - arrival AS e2e_us,
       CASE WHEN n > 1 THEN (completion - arrival)::DOUBLE / (n - 1) END AS itl_us FROM r
"""


def suite_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the request metrics over all requests, by whether a click came."""
    m = request_metrics(spark, sf).withColumn("clicked", F.col("ttft_us").isNotNull())
    named = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    a = stats.percentiles(m, ["clicked"], "ttft_us", {f"ttft_{k}": v for k, v in named.items()})
    b = stats.percentiles(m, ["clicked"], "e2e_us", {f"e2e_{k}": v for k, v in named.items()})
    return a.join(b, "clicked")


SUITE = "WITH m AS (" + REQUEST_METRICS + """)
SELECT ttft_us IS NOT NULL AS clicked,
       quantile_cont(ttft_us::DOUBLE, 0.5) AS ttft_p50, quantile_cont(ttft_us::DOUBLE, 0.95) AS ttft_p95, quantile_cont(ttft_us::DOUBLE, 0.99) AS ttft_p99,
       quantile_cont(e2e_us::DOUBLE, 0.5) AS e2e_p50, quantile_cont(e2e_us::DOUBLE, 0.95) AS e2e_p95, quantile_cont(e2e_us::DOUBLE, 0.99) AS e2e_p99
FROM m GROUP BY 1
"""


def memory_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks in use after each turn of a conversation: the peak, and the peak's share of 64 blocks."""
    t = _tokens(spark, sf)
    held = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn"))
    samples = t.select("conv_id", numbers.blocks(held, BLOCK).alias("used"))
    peak = samples.groupBy("conv_id").agg(F.max("used").alias("peak_blocks"), F.count("*").alias("n_samples"))
    return peak.withColumn("peak_share", numbers.safe_ratio("peak_blocks", F.lit(64)))


MEMORY_PEAKS = _TOKENS + """,
s AS (SELECT conv_id, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) + 15)::BIGINT // 16 AS used FROM t)
SELECT conv_id, max(used) AS peak_blocks, count(*) AS n_samples, max(used)::DOUBLE / 64 AS peak_share FROM s GROUP BY conv_id
"""


def suite_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as requests of four cases: a turn is a step, and what opens like an earlier conversation of its case hits the cache."""
    t = _tokens(spark, sf).withColumn("case", F.col("conv_id") % 4)
    spoken = F.col("role") == "assistant"
    sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("long")
    r = t.groupBy("case", "conv_id").agg(
        F.max_by("role", "turn").alias("last"), sums(~spoken).alias("prompt_tokens"), sums(spoken).alias("output_tokens"), F.count("*").alias("n"),
        F.sha2(F.min_by("text", "turn"), 256).alias("head"), F.min_by("tokens", "turn").alias("head_tokens"), F.bool_or(spoken).alias("answered"),
    )
    first = F.row_number().over(Window.partitionBy("case", "head").orderBy("conv_id")) == 1
    done = F.col("last") == "assistant"
    r = r.withColumn("hit", ~first).withColumn("arrival", F.col("conv_id") % 97)
    begun = F.when(F.col("answered"), F.col("arrival") + F.col("prompt_tokens"))
    requests = r.select(
        "case", F.when(done, "COMPLETED").otherwise("FAILED").alias("state"), "arrival", begun.alias("first_token"), F.when(done, begun + F.col("output_tokens")).alias("completion"),
        "prompt_tokens", "output_tokens", F.when(done, 0).otherwise(F.col("head_tokens")).alias("recomputed_tokens"),
        F.when(F.col("hit"), numbers.whole_blocks("head_tokens", BLOCK)).otherwise(0).alias("reused_tokens"), F.when(done, 0).otherwise(1).alias("preemptions"),
    )
    held = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn"))
    moment = (F.col("conv_id") * 10 + F.col("turn")).alias("time")
    samples = t.select("case", moment, numbers.blocks(held, BLOCK).alias("used_blocks"), numbers.blocks("tokens", BLOCK).alias("cached_blocks"), F.lit(256).alias("total_blocks"))
    steps = t.select("case", moment, F.lit("STEP").alias("kind"))
    looked = r.select("case", F.col("arrival").alias("time"), F.when(F.col("hit"), "PREFIX_CACHE_HIT").otherwise("PREFIX_CACHE_MISS").alias("kind"))
    return serving.suite_metrics(requests, samples, steps.unionByName(looked))


SUITE_METRICS = _TOKENS + """,
c AS (SELECT *, conv_id % 4 AS "case" FROM t),
r AS (SELECT "case", conv_id, max_by(role, turn) = 'assistant' AS done, coalesce(sum(tokens) FILTER (role <> 'assistant'), 0)::BIGINT AS p,
             coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS o, sha256(min_by(text, turn)) AS head, min_by(tokens, turn) AS h, bool_or(role = 'assistant') AS answered
      FROM c GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY "case", head ORDER BY conv_id) > 1 AS hit, conv_id % 97 AS arrival, CASE WHEN answered THEN p END AS ttft,
             CASE WHEN done AND answered THEN p + o END AS e2e, CASE WHEN done AND answered AND o > 1 THEN o / (o - 1) END AS itl FROM r),
m AS (SELECT "case", count(*) AS total_requests, count(*) FILTER (done) AS completed_requests, count(*) FILTER (NOT done) AS failed_requests, sum(p)::BIGINT AS prompt_tokens,
             sum(o)::BIGINT AS output_tokens, sum(CASE WHEN done THEN 0 ELSE h END)::BIGINT AS recomputed_tokens, sum(CASE WHEN hit THEN h // 16 * 16 ELSE 0 END)::BIGINT AS prefix_reused_tokens,
             count(*) FILTER (NOT done) AS preemption_count, avg(ttft)::DOUBLE AS average_ttft, avg(e2e)::DOUBLE AS average_e2e, avg(itl) AS average_itl,
             quantile_cont(ttft::DOUBLE, 0.5) AS p50_ttft, quantile_cont(ttft::DOUBLE, 0.95) AS p95_ttft, quantile_cont(ttft::DOUBLE, 0.99) AS p99_ttft,
             quantile_cont(e2e::DOUBLE, 0.5) AS p50_e2e, quantile_cont(e2e::DOUBLE, 0.95) AS p95_e2e, quantile_cont(e2e::DOUBLE, 0.99) AS p99_e2e,
             count(*) FILTER (hit) AS prefix_cache_hits, count(*) FILTER (NOT hit) AS prefix_cache_misses, max(arrival) AS latest FROM q GROUP BY "case"),
u AS (SELECT "case", conv_id * 10 + turn AS time, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) + 15)::BIGINT // 16 AS used, (tokens + 15) // 16 AS cached FROM c),
k AS (SELECT "case", max_by(used, (time, used)) AS used_blocks, max(used) AS peak_used_blocks, max(cached) AS peak_cached_blocks, count(*) AS iterations, max(time) AS elapsed FROM u GROUP BY "case"),
a AS (SELECT m.* EXCLUDE latest, k.* EXCLUDE ("case", elapsed), greatest(elapsed, latest)::DOUBLE AS elapsed, prompt_tokens + output_tokens + recomputed_tokens AS processed_tokens
      FROM m JOIN k USING ("case"))
SELECT *, prompt_tokens * 1000.0::DOUBLE / elapsed AS prompt_per_second, output_tokens * 1000.0::DOUBLE / elapsed AS output_per_second,
       processed_tokens * 1000.0::DOUBLE / elapsed AS processed_per_second, used_blocks::DOUBLE / 256 AS used_share, peak_used_blocks::DOUBLE / 256 AS peak_used_share,
       peak_cached_blocks::DOUBLE / 256 AS peak_cached_share, prefix_cache_hits::DOUBLE / (prefix_cache_hits + prefix_cache_misses) AS prefix_cache_hit_rate FROM a
"""

PLANS = {
    "request_blocks": (request_blocks, REQUEST_BLOCKS),
    "prefix_reuse": (prefix_reuse, PREFIX_REUSE),
    "step_costs": (step_costs, STEP_COSTS),
    "request_metrics": (request_metrics, REQUEST_METRICS),
    "suite_aggregate": (suite_aggregate, SUITE),
    "suite_metrics": (suite_metrics, SUITE_METRICS),
    "memory_peaks": (memory_peaks, MEMORY_PEAKS),
}
