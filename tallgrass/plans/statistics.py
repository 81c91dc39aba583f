"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import stats
from ..sources.tables import table


def event_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


PERCENTILES = """
SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type
"""

_FEATURES = ["n_bytes", "n_lines", "n_words"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", "lang",
        F.octet_length("text").alias("n_bytes"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Za-z]+")).alias("n_words"),
    )


_FEATURES_SQL = """
WITH f AS (SELECT doc_id, lang, strlen(text)::DOUBLE AS n_bytes, len(string_split(text, chr(10)))::DOUBLE AS n_lines,
                  len(regexp_extract_all(text, '[A-Za-z]+'))::DOUBLE AS n_words FROM documents),
long AS (SELECT doc_id, lang, feature, value FROM f UNPIVOT (value FOR feature IN (n_bytes, n_lines, n_words)))
"""


def feature_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distributions(_features(spark, sf), _FEATURES)


DISTRIBUTIONS = _FEATURES_SQL + """
SELECT feature, min(value) AS least, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS p75, max(value) AS greatest FROM long GROUP BY feature
"""


def anchor_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the least toxic-labelled document of each language stands among all documents."""
    docs = _features(spark, sf)
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    chosen = docs.join(toxic, "doc_id").groupBy("lang").agg(*[F.min(f).alias(f) for f in _FEATURES])
    anchors = stats.long_format(chosen, ["lang"], _FEATURES).select(F.col("lang").alias("anchor"), "feature", F.col("value").alias("anchor_value"))
    return stats.positions(docs, anchors, _FEATURES)


POSITIONS = _FEATURES_SQL + """,
anchors AS (SELECT lang AS anchor, feature, min(value) AS anchor_value FROM long JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY ALL),
counts AS (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL)
SELECT anchor, feature, anchor_value, coalesce(sum(n) FILTER (value < anchor_value), 0)::BIGINT AS n_below,
       coalesce(sum(n) FILTER (value = anchor_value), 0)::BIGINT AS n_equal, coalesce(sum(n) FILTER (value > anchor_value), 0)::BIGINT AS n_above
FROM anchors JOIN counts USING (feature) GROUP BY anchor, feature, anchor_value
"""


def case_comparison(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n_items"), F.sum("l_quantity").alias("quantity"), F.max("l_quantity").alias("largest")
    )
    return stats.compare(cases, "l_returnflag", "N", ["n_items", "quantity", "largest"])


COMPARISON = """
WITH c AS (SELECT l_returnflag, count(*)::DOUBLE AS n_items, sum(l_quantity)::DOUBLE AS quantity, max(l_quantity)::DOUBLE AS largest FROM lineitem GROUP BY ALL),
l AS (SELECT * FROM c UNPIVOT (value FOR metric IN (n_items, quantity, largest)))
SELECT o.l_returnflag, o.metric, b.value AS base, o.value, o.value - b.value AS delta,
       CASE WHEN b.value <> 0 THEN (o.value - b.value) * 100.0::DOUBLE / b.value END AS percent
FROM l o JOIN l b ON o.metric = b.metric AND b.l_returnflag = 'N' AND o.l_returnflag <> 'N'
"""


def null_strict_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums that a single missing purchase makes unknown."""
    e = table(spark, sf, "events").withColumn("amount", F.when(F.col("event_type") != "error", F.length("props").cast("long")))
    return e.groupBy("user_id").agg(numbers.strict_sum("amount").cast("double").alias("strict_total"), F.sum("amount").alias("loose_total"))


STRICT_SUM = """
WITH e AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN length(props) END AS amount FROM events)
SELECT user_id, CASE WHEN count(amount) = count(*) THEN sum(amount) END::DOUBLE AS strict_total, sum(amount)::BIGINT AS loose_total FROM e GROUP BY user_id
"""


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses")
    )
    return e.select("user_id", "hits", "misses", numbers.safe_ratio("hits", F.col("hits") + F.col("misses")).alias("hit_rate"))


HIT_RATE = """
WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY user_id)
SELECT *, CASE WHEN hits + misses = 0 THEN 0.0 ELSE hits::DOUBLE / (hits + misses) END AS hit_rate FROM e
"""


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every kind for every user, 0 where there is none."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


EVENT_COUNTS = "SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "signup", "view")
) + " FROM events GROUP BY user_id"


def outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Documents above the third quartile of bytes, or below the first of lines, of their language."""
    docs = _features(spark, sf)
    limits = docs.groupBy("lang").agg(F.percentile("n_bytes", 0.75).alias("high"), F.percentile("n_lines", 0.25).alias("low"))
    return docs.join(limits, "lang").select(
        "doc_id", (F.col("n_bytes") > F.col("high")).alias("is_large"), (F.col("n_lines") < F.col("low")).alias("is_flat")
    )


OUTLIERS = _FEATURES_SQL + """,
limits AS (SELECT lang, quantile_cont(n_bytes, 0.75) AS high, quantile_cont(n_lines, 0.25) AS low FROM f GROUP BY lang)
SELECT doc_id, n_bytes > high AS is_large, n_lines < low AS is_flat FROM f JOIN limits USING (lang)
"""


def archetype_rollup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("string"))
    return docs.rollup("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))


ROLLUP = """
SELECT lang, quality, count(*) AS n, sum(toxic)::BIGINT AS n_toxic
FROM (SELECT lang, quality::VARCHAR AS quality, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang, quality)
"""

PLANS = {
    "event_percentiles": (event_percentiles, PERCENTILES),
    "feature_distributions": (feature_distributions, DISTRIBUTIONS),
    "anchor_positions": (anchor_positions, POSITIONS),
    "case_comparison": (case_comparison, COMPARISON),
    "null_strict_sum": (null_strict_sum, STRICT_SUM),
    "hit_rate": (hit_rate, HIT_RATE),
    "event_counts": (event_counts, EVENT_COUNTS),
    "outlier_flags": (outlier_flags, OUTLIERS),
    "archetype_rollup": (archetype_rollup, ROLLUP),
}
