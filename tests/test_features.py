import random

import models
import pytest
from corpusloom.functions.features import BUCKETS, FEATURES, with_bucket, with_features

WORDS = ["select", "SELECT", "FROM", "t", "JOIN", "\nJOIN", "GROUP BY", "GROUP  BY", "HAVING",
         "UNION", "unions", "EXCEPT", "ORDER BY", "COUNT(", "MAX (", "OVER (", "x_count(",
         "'union'", "éUNION", "selected_at"]


@pytest.mark.parametrize("sql, expected", [
    ("SELECT selected_at FROM t", "nested"),
    ("SELECT a FROM t WHERE n = 'union'", "set_op"),
    ("SELECT a FROM t\nJOIN u ON x = y", "simple"),
    ("SELECT a FROM t JOIN u ON x = y", "single_join"),
    ("SELECT a FROM t JOIN JOIN u", "single_join"),
    ("select a from t join u join v", "multi_join"),
    ("SELECT a FROM t GROUP BY a HAVING x > 1", "having"),
    ("SELECT a FROM t GROUP BY a ORDER BY a", "group_by"),
    ("SELECT count\t(a) FROM t", "single_table_analytic"),
    ("SELECT discount(a) FROM t", "simple"),
    ("SELECT éUNION FROM t", "simple"),
])
def test_bucket(spark, sql, expected):
    df = spark.createDataFrame([(sql,)], "sql string")
    assert with_bucket(df, "sql").first()["bucket"] == expected


def test_bucket_equals_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    got = {r["sql"]: r["bucket"] for r in with_bucket(df, "sql").collect()}
    assert got == {t: models.bucket(t) for t in texts}
    assert set(got.values()) == set(BUCKETS)


def test_features_are_not_exclusive(spark):
    sql = "SELECT COUNT(*) OVER (x) FROM t JOIN u GROUP BY a HAVING b ORDER BY (SELECT 1) UNION c"
    rows = spark.createDataFrame([(sql,), ("SELECT a FROM t",)], "sql string")
    full, plain = with_features(rows, "sql").collect()
    assert all(full[f"has_{name}"] for name in FEATURES)
    assert not any(plain[f"has_{name}"] for name in FEATURES)


def test_padded_text_is_computed_once(spark):
    df = spark.createDataFrame([("a",)], "sql string")
    plan = with_bucket(df, "sql")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
