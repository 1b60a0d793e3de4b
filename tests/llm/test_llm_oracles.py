import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.llm.oracles import ORACLES
from odd_documents import TESTDATA


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    sf_dir = str(TESTDATA / "sf0.01")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = con.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    frame = entry.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted([tuple(r) for r in frame.select(*columns).collect()], key=repr)
    assert got == sorted(expected.fetchall(), key=repr)
