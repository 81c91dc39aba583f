"""Metrics of serving cases from their requests, samples of memory and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from . import stats

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def request_latencies(requests: DataFrame) -> DataFrame:
    """requests with ttft, e2e and itl; null where first_token or completion is, itl also below two tokens of output."""
    between = (F.col("completion") - F.col("first_token")) / (F.col("output_tokens") - 1)
    return requests.withColumns({
        "ttft": (F.col("first_token") - F.col("arrival")).cast("double"), "e2e": (F.col("completion") - F.col("arrival")).cast("double"),
        "itl": F.when(F.col("output_tokens") > 1, between),
    })


def suite_metrics(requests: DataFrame, samples: DataFrame, events: DataFrame) -> DataFrame:
    """One row a case of requests: counts, tokens, throughput, latencies, memory and prefix cache.

    requests: case, state, arrival, first_token, completion (milliseconds), prompt_tokens, output_tokens, recomputed_tokens,
    reused_tokens, preemptions. samples: case, time, used_blocks, cached_blocks, total_blocks. events: case, time, kind. A case without
    samples or events has zeros there; means and percentiles of nothing are null. The case's time is that of its last event.
    """
    timed = request_latencies(requests)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    base = timed.groupBy("case").agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("state") == "COMPLETED").alias("completed_requests"),
        F.count_if(F.col("state") == "FAILED").alias("failed_requests"), total("prompt_tokens").alias("prompt_tokens"), total("output_tokens").alias("output_tokens"),
        total("recomputed_tokens").alias("recomputed_tokens"), total("reused_tokens").alias("prefix_reused_tokens"), total("preemptions").alias("preemption_count"),
        *[F.avg(c).alias(f"average_{c}") for c in ("ttft", "e2e", "itl")],
    )
    for latency in ("ttft", "e2e"):
        base = base.join(stats.percentiles(timed, ["case"], latency, {f"{p}_{latency}": s for p, s in SHARES.items()}), "case", "left")
    kind = lambda k: F.count_if(F.col("kind") == k)
    seen = events.groupBy("case").agg(
        F.max("time").cast("double").alias("elapsed"), kind("STEP").alias("iterations"), kind("PREFIX_CACHE_HIT").alias("prefix_cache_hits"),
        kind("PREFIX_CACHE_MISS").alias("prefix_cache_misses"),
    )
    last = F.max_by(F.struct("used_blocks", "total_blocks"), F.struct("time", "used_blocks"))
    memory = samples.groupBy("case").agg(
        last.alias("last"), F.max("used_blocks").alias("peak_used_blocks"), F.max("cached_blocks").alias("peak_cached_blocks"), F.max("total_blocks").alias("blocks"),
    ).select("case", F.col("last.used_blocks").alias("used_blocks"), "peak_used_blocks", "peak_cached_blocks", "blocks")
    counted = ["elapsed", "iterations", "prefix_cache_hits", "prefix_cache_misses", "used_blocks", "peak_used_blocks", "peak_cached_blocks", "blocks"]
    all_of = base.join(seen, "case", "left").join(memory, "case", "left").fillna(0, counted)
    tokens = F.col("prompt_tokens") + F.col("output_tokens") + F.col("recomputed_tokens")
    each = all_of.withColumn("processed_tokens", tokens)
    speeds = {f"{n}_per_second": numbers.per_second(f"{n}_tokens", "elapsed") for n in ("prompt", "output", "processed")}
    held = {f"{n}_share": numbers.safe_ratio(f"{n}_blocks", "blocks") for n in ("used", "peak_used", "peak_cached")}
    rate = numbers.safe_ratio("prefix_cache_hits", F.col("prefix_cache_hits") + F.col("prefix_cache_misses"))
    return each.withColumns(speeds | held | {"prefix_cache_hit_rate": rate}).drop("blocks")
