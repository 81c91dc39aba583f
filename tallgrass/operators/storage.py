"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local master may fall back to a temporary folder, as no other machine reads it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or context.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so a lost executor costs no recomputation of it.

    Spark removes a checkpoint when it is no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut_lineage for large tables: Parquet in the shared folder, a fraction of a checkpoint's size.

    Results are read lazily, so the files stay; whoever owns the folder removes stored-* once a run is over.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task takes where spread deals them.
TASK_ROWS = 1 << 17


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks that each gets about TASK_ROWS of n_rows, however large the table.

    What is sorted or grouped by these keys afterwards stays in its task. A number given by hand is kept by
    adaptive execution, which otherwise fills tasks with whatever compresses to its advisory size.
    """
    return df.repartition(1 + n_rows // TASK_ROWS, *keys)
