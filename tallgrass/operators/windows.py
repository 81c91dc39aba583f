"""Sequence operators: gaps, runs, ledgers, allocations in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def gaps(rows: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Each row with the time since the one before it of its key; null for the first."""
    return rows.withColumn("gap", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(*order)))


def runs(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Runs of neighbours of equal value: keys, run number, value, length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def seen_before(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each row with whether an earlier row of its key has the same value."""
    w = Window.partitionBy(*keys, value).orderBy(*order)
    return rows.withColumn("seen_before", F.row_number().over(w) > 1)


def ledger(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each row with the number of distinct values known before and after it."""
    marked = seen_before(rows, keys, value, order).withColumn("adds", (~F.col("seen_before")).cast("long"))
    after = F.sum("adds").over(Window.partitionBy(*keys).orderBy(*order))
    return marked.withColumn("known_after", after).withColumn("known_before", F.col("known_after") - F.col("adds")).drop("adds")


def running_total(rows: DataFrame, keys: list[str], amount: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(amount).over(w))


def round_robin(rows: DataFrame, group: list[str], task: list[str], rank: list[str], limit: int) -> DataFrame:
    """Within a task: the first member of every group, then the second of every group, until limit is used."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*task, *group).orderBy(*rank)))
    place = F.row_number().over(Window.partitionBy(*task).orderBy("turn", *group))
    return turn.withColumn("place", place).where(F.col("place") <= limit)


def first_fit(rows: DataFrame, keys: list[str], cost: str, order: list[str], budget: int) -> DataFrame:
    """Each row with whether it is taken: in order, a row that would pass the key's budget is skipped, later ones may fit.

    Rows come sorted by key and order within partitions and are folded as they stream by, so a
    key's rows are never collected.
    """
    schema = StructType([*rows.schema.fields, StructField("taken", BooleanType()), StructField("used", LongType())])
    names = [f.name for f in schema]
    at, price = [rows.columns.index(k) for k in keys], rows.columns.index(cost)

    def fold(batches):
        import pyarrow as pa

        current, used = None, 0
        for batch in batches:
            keyed = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            taken, after = [], []
            for key, n in zip(keyed, batch.column(price).to_pylist(), strict=True):
                if key != current:
                    current, used = key, 0
                fits = n is not None and used + n <= budget
                used += n if fits else 0
                taken.append(fits)
                after.append(used)
            columns = [*batch.columns, pa.array(taken, pa.bool_()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, schema)
