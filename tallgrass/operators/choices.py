"""Choices that abstain: a winner counts only if nothing else is as good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_best(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """For each key the value of greatest weight, null if several values share it; with that weight.

    The least and the greatest of the best values are taken in one pass that combines before the shuffle; they are the
    same exactly if the winner is alone. Repeated rows of one value are no tie. Rows of null value or weight do not count,
    and a key with no others has null for both.
    """
    counts = F.col(value).isNotNull() & F.col(weight).isNotNull()
    last = F.max(F.when(counts, F.struct(F.col(weight).alias("w"), F.col(value).alias("v"))))
    first = F.min(F.when(counts, F.struct((-F.col(weight)).alias("w"), F.col(value).alias("v"))))
    both = rows.groupBy(*keys).agg(last.alias("last"), first.alias("first"))
    alone = F.when(F.col("last.v") == F.col("first.v"), F.col("last.v"))
    return both.select(*keys, alone.alias(value), F.col("last.w").alias(weight))


def resolved_names(cited: DataFrame, symbols: DataFrame) -> DataFrame:
    """cited (..., name) with path and qualified_name of the one symbol (path, qualified_name) that the name can mean.

    A name means every symbol whose qualified name it equals or ends, at a dot; of those that equal it, only they count.
    Several give null, as does none; candidates tells how many there were. Symbols offer all their endings, so the join
    is by equality.
    """
    parts = F.split("qualified_name", r"\.")
    ending = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, n, F.size(parts))))
    offered = symbols.select("path", "qualified_name").distinct().select("path", "qualified_name", F.explode(ending).alias("name"))
    whole = (F.col("name") == F.col("qualified_name")).cast("int")
    entry = F.struct("path", "qualified_name")
    best = offered.select("name", whole.alias("whole"), "path", "qualified_name").groupBy("name", "whole").agg(
        F.count("*").alias("candidates"), F.min(entry).alias("only")
    )
    chosen = best.groupBy("name").agg(F.max_by(F.struct("candidates", "only"), "whole").alias("best"))
    one = F.when(F.col("best.candidates") == 1, F.col("best.only"))
    joined = cited.join(chosen, "name", "left").withColumn("one", one)
    return joined.select(
        *cited.columns, F.col("one.path").alias("path"), F.col("one.qualified_name").alias("qualified_name"),
        F.coalesce("best.candidates", F.lit(0)).alias("candidates"),
    )
