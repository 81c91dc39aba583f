"""Comparing snapshots of a table by key and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Every key of either side as created, modified, unchanged or deleted."""
    a = old.select(key, F.col(digest).alias("old_digest"))
    b = new.select(key, F.col(digest).alias("new_digest"))
    status = (
        F.when(F.col("old_digest").isNull(), "created")
        .when(F.col("new_digest").isNull(), "deleted")
        .when(F.col("old_digest") == F.col("new_digest"), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def stale(noted: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Notes (key, digest) whose file is gone (FILE_REMOVED) or differs (FILE_CHANGED)."""
    now = current.select(key, F.col(digest).alias("now"))
    reason = F.when(F.col("now").isNull(), "FILE_REMOVED").when(F.col("now") != F.col(digest), "FILE_CHANGED")
    return noted.join(now, key, "left").withColumn("reason", reason).where("reason is not null").drop("now")


def reusable(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """scanned (path, sha256, size) with whether the old record of equal hash and size may be used again."""
    known = old.select("path", "sha256", "size", F.lit(True).alias("reused"))
    return scanned.join(known, ["path", "sha256", "size"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
