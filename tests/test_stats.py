import random
import statistics

import pytest

from corpusloom.functions.features import FEATURES, with_features
from corpusloom.operators import stats
from corpusloom.operators.scoring import score, score_by, score_rows


def expected_profile(lengths):
    ordered = sorted(lengths)
    return (len(ordered), int(statistics.median(ordered)), ordered[int(0.9 * len(ordered))],
            ordered[-1], int(ordered[-1] / 3.5))


@pytest.mark.parametrize("lengths", [
    [5], [1, 2], [2, 5], list(range(1, 11)), [3] * 30, list(range(0, 99)) + [7] * 40,
    [random.Random(n).randint(0, 900) for n in range(501)],
])
def test_length_profile(spark, lengths):
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    assert tuple(stats.length_profile(df, "n").first()) == expected_profile(lengths)


def test_length_profile_by_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randint(0, 50)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, n int")
    got = {r[0]: tuple(r)[1:] for r in stats.length_profile(df, "n", ["g"]).collect()}
    assert got == {g: expected_profile([n for h, n in rows if h == g]) for g in "ab"}


def test_length_preview(spark):
    lengths = [(i, "x" * ((i * 37) % 500)) for i in range(300)]
    df = spark.createDataFrame(lengths, "ord long, t string")
    tokens = sorted(int(len(t) / 3.5) for _, t in lengths[:200])
    assert tuple(stats.length_preview(df, "t").first()) == (tokens[100], tokens[-1])


def test_feature_rollup(spark):
    rows = [("a", "SELECT 1"), ("a", "SELECT x FROM t JOIN u"), ("b", "SELECT x FROM t JOIN u")]
    df = with_features(spark.createDataFrame(rows, "source string, sql string"), "sql")
    got = {r["source"]: (r["n"], r["join"]) for r in stats.feature_rollup(df).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "merged": (3, 2)}
    total = stats.feature_totals(df).first()
    assert total["n"] == 3 and [total[f] for f in FEATURES] == [2, 0, 0, 0, 0, 0, 0, 0]


def test_distinct_dbs(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "db_id string")
    assert stats.distinct_dbs(df).first()["distinct_dbs"] == 2


def test_cleaning_report(spark):
    df = spark.createDataFrame([(True, True), (False, False), (False, True)],
                               "fixed boolean, parses boolean")
    assert tuple(stats.cleaning_report(df).first()) == (3, 1, 1)


PAIRS = [
    (0, "SELECT a FROM t", "select  a\nFROM t;"),
    (1, "SELECT a, b FROM t", "SELECT a , b FROM t"),
    (2, "SELECT a FROM t", "SELECT b FROM t"),
    (3, "SELECT a FROM t", "SELECT FROM"),
    (4, "SELECT a FROM t WHERE n = 'x  y'", "SELECT a FROM t WHERE n='X Y'"),
]


def test_score(spark):
    df = score_rows(spark.createDataFrame(PAIRS, "rec_id long, gold string, pred string"))
    assert tuple(score(df).first()) == (5, 4, 3, 0.8, 0.6)
    manifest = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "rec_id long, tier string")
    got = {r["tier"]: (r["n"], r["parse_ok"], r["em"])
           for r in score_by(df, manifest, ["tier"]).collect()}
    assert got == {"a": (3, 3, 2), "b": (2, 1, 1)}


def test_score_of_nothing_is_null(spark):
    df = score_rows(spark.createDataFrame([], "rec_id long, gold string, pred string"))
    assert tuple(score(df).first()) == (0, 0, 0, None, None)
