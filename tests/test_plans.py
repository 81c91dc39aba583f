"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallgrass import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = plans.QUERIES[name](spark, SF)
    expected = oracle.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(expected.columns, expected.fetchall())
