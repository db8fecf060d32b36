"""Every registered query against its checking SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows

# The training-data queries have tests of their own.
QUERIES, CHECKS = entry.QUERIES, entry.CHECKS


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = _rows(df.columns, df.collect())
    assert found[1]
    if name in CHECKS:
        result = db.execute(CHECKS[name])
        assert found == _rows([c[0] for c in result.description], result.fetchall())


def test_checks_belong_to_queries():
    assert set(CHECKS) == set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
