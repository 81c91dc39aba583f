"""Versions of a table: what readers see while and after writers run, and after one fails."""

import pytest
from pyspark.sql import functions as F

from tallgrass import sinks


def test_readers_see_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert sinks.current_version(spark, folder) is None and sinks.drop_versions(spark, folder) == 0
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, folder)
    first = sinks.write_current(spark.range(5), folder)
    opened = sinks.read_current(spark, folder)
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_current(broken, folder)
    assert sinks.current_version(spark, folder) == first and sinks.read_current(spark, folder).count() == 5
    # The next version may be made from the one before.
    second = sinks.write_current(sinks.read_current(spark, folder).union(spark.range(2)), folder)
    assert second != first and sinks.read_current(spark, folder).count() == 7 and opened.count() == 5
    assert sinks.drop_versions(spark, folder) >= 1
    assert sinks.read_current(spark, folder).count() == 7 and sinks.drop_versions(spark, folder) == 0
    assert sinks.drop_versions(spark, folder, keep_current=False) == 1 and sinks.current_version(spark, folder) is None
    assert sinks.write_current(spark.range(0), folder) and sinks.read_current(spark, folder).count() == 0
