"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry_point
from corpusloom.registry.oracles import ORACLES
from corpusloom.registry.queries import QUERIES

SF = TESTDATA / "sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, oracle, name):
    df = QUERIES[name](spark, str(SF))
    result = oracle.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_known_bucket_totals(spark):
    """Totals worked out beforehand for the second-smallest tables."""
    df = QUERIES["bucket_counts"](spark, str(TESTDATA / "sf0.01"))
    totals = {r["bucket"]: r["n"] for r in df.groupBy("bucket").sum("n").toDF("bucket", "n").collect()}
    assert totals == {
        "set_op": 732, "nested": 1518, "having": 1511, "multi_join": 2287, "group_by": 1478,
        "single_join": 3685, "single_table_analytic": 2238, "simple": 1551,
    }
