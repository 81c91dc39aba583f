"""Line-delimited JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = (
    "schema_version INT, timestamp STRING, tool STRING, server_session_id STRING, call_sequence BIGINT, success BOOLEAN, "
    "error_type STRING, metrics MAP<STRING,BIGINT>, "
    "delivery ARRAY<STRUCT<path:STRING,content_hash:STRING,start_line:BIGINT,end_line:BIGINT,line_bytes:ARRAY<BIGINT>>>"
)
VERSIONS = (1, 2, 3)


def run_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (run_id, line_no, value) of JSON logs, one run a file; blank lines do not count.

    A log is one run's file, so its lines are numbered in its own window.
    """
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    name = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1)
    lines = text.select(name.alias("run_id"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    return lines.where(F.trim("value") != "").select("run_id", (F.col("at") + 1).alias("line_no"), "value")


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a usage log, with valid saying whether the line is one of a known version."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    entry = F.from_json("value", USAGE)
    return raw.select(entry.alias("e")).select("e.*").withColumn("valid", F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False)))
