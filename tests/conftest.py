import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staged")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Apply a column function to literal texts and return the values in order."""

    def run(function, texts, column_type="string"):
        df = spark.createDataFrame(list(enumerate(texts)), f"i int, c {column_type}")
        rows = df.select("i", function(df["c"]).alias("v")).orderBy("i").collect()
        return [r["v"] for r in rows]

    return run


def final_plan(df):
    """Text of the physical plan after the query has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
