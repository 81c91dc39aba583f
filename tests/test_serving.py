"""Metrics of cases: what is there, what is missing, and what is zero."""

import pytest

from tallgrass.operators import serving

REQUESTS = (
    "case string, state string, arrival double, first_token double, completion double, prompt_tokens long, output_tokens long, "
    "recomputed_tokens long, reused_tokens long, preemptions int"
)


def test_metrics_of_cases(spark):
    requests = [
        ("a", "COMPLETED", 0.0, 10.0, 50.0, 100, 5, 0, 16, 0), ("a", "COMPLETED", 5.0, 25.0, 25.0, 50, 1, 10, 0, 2),
        ("a", "FAILED", 9.0, 19.0, None, 7, 3, 0, 0, 1), ("a", "RUNNING", 9.0, None, None, 7, 0, None, 0, 0), ("b", "FAILED", 1.0, None, None, 3, 0, 0, 0, 0),
    ]
    samples = spark.createDataFrame([("a", 1.0, 8, 1, 16), ("a", 2.0, 12, 4, 16), ("a", 3.0, 2, 3, 16)], "case string, time double, used_blocks int, cached_blocks int, total_blocks int")
    kinds = ["STEP", "STEP", "PREFIX_CACHE_HIT", "PREFIX_CACHE_MISS", "PREFIX_CACHE_HIT", "OTHER"]
    events = spark.createDataFrame([("a", float(10 * i), k) for i, k in enumerate(kinds)], "case string, time double, kind string")
    got = {r["case"]: r.asDict() for r in serving.suite_metrics(spark.createDataFrame(requests, REQUESTS), samples, events).collect()}
    expected = {
        "total_requests": 4, "completed_requests": 2, "failed_requests": 1, "prompt_tokens": 164, "output_tokens": 9, "recomputed_tokens": 10, "prefix_reused_tokens": 16,
        "preemption_count": 3, "average_ttft": 40 / 3, "p50_ttft": 10.0, "p95_ttft": 19.0, "p99_ttft": 19.8, "average_e2e": 35.0, "p50_e2e": 35.0, "p95_e2e": 48.5,
        "p99_e2e": 49.7, "average_itl": 10.0, "elapsed": 50.0, "iterations": 2, "prefix_cache_hits": 2, "prefix_cache_misses": 1, "prefix_cache_hit_rate": 2 / 3,
        "used_blocks": 2, "peak_used_blocks": 12, "peak_cached_blocks": 4, "used_share": 0.125, "peak_used_share": 0.75, "peak_cached_share": 0.25,
        "processed_tokens": 183, "prompt_per_second": 3280.0, "output_per_second": 180.0, "processed_per_second": 3660.0,
    }
    assert {k: v for k, v in got["a"].items() if k != "case"} == pytest.approx(expected)
    b = got["b"]
    assert (b["total_requests"], b["failed_requests"], b["average_ttft"], b["p99_e2e"], b["elapsed"], b["peak_used_share"], b["prompt_per_second"]) == (1, 1, None, None, 0, 0, 0)
    assert serving.suite_metrics(spark.createDataFrame([], REQUESTS), samples, events).count() == 0
