"""Writers of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Line-delimited JSON with nulls written out; a run that fails leaves no committed files."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    nested = {n: F.to_json(n) for n, kind in df.dtypes if kind.startswith(("struct", "array", "map"))}
    (df.withColumns(nested) if nested else df).write.mode("overwrite").option("header", "true").csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet at a path that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Entries added to a line-delimited log."""
    df.write.mode("append").json(path)


def write_current(df: DataFrame, folder: str) -> str:
    """A new version of a table under folder, which readers see at once and whole; returns its name.

    The version is written beside the others; then a pointer of one line takes the place of the last one by one rename. A
    run that fails before it leaves readers where they were. Of two writers the later rename wins.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{version}")
    jvm, files, path = _file_context(spark, folder)
    draft, pointer = path(f"{folder}/next-{version}"), path(f"{folder}/CURRENT")
    create = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(draft, create, no_options)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, pointer, how)
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    """Name of the version that readers see; null before the first."""
    _, files, path = _file_context(spark, folder)
    if not files.util().exists(path(f"{folder}/CURRENT")):
        return None
    return spark.read.text(f"{folder}/CURRENT").first()[0]


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/versions/{version}")


def drop_versions(spark: SparkSession, folder: str, keep_current: bool = True) -> int:
    """Removes versions that no reader will be pointed to, or all with the pointer; how many were removed.

    Readers that opened an older version before lose it, so this is for times when none is running.
    """
    _, files, path = _file_context(spark, folder)
    if not files.util().exists(path(f"{folder}/versions")):
        return 0
    kept = current_version(spark, folder) if keep_current else None
    if not keep_current:
        files.delete(path(f"{folder}/CURRENT"), False)
    names = [f.getPath().getName() for f in files.util().listStatus(path(f"{folder}/versions"))]
    gone = [n for n in names if n != kept]
    for name in gone:
        files.delete(path(f"{folder}/versions/{name}"), True)
    return len(gone)


def _file_context(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path
