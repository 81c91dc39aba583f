"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import cut_lineage, shared_folder, stored  # noqa: F401

#: A word is a maximal run without ASCII white space (space, \t, \n, \v, \f, \r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; bytes.lower and bytes.split touch ASCII only."""
    return text.encode().lower().split() if text else []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(modulus: int, remainder: int = 2) -> Column:
    """True where crc32 of doc_id as text leaves the remainder; a null doc_id counts as empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text) % modulus == remainder


def map_rows(df: DataFrame, schema: StructType | str, per_batch: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow with a function from a batch to the output columns in schema order."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = per_batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[n] for n in names)], names
                )

    return df.mapInArrow(run, schema)
