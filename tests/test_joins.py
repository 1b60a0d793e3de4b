import random

import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from corpusloom.operators import joins
from corpusloom.operators.joins import align, lookup_join, remaining, with_group_size


@pytest.fixture(scope="module")
def sides(spark):
    """Two keys and null hold most rows; some keys have no partner."""
    rng = random.Random(2)
    keys = ["hot"] * 30 + ["warm"] * 10 + [None] * 20 + [f"k{i}" for i in range(60)]
    rows = [(i, rng.choice(keys)) for i in range(3000)]
    table = [(k, f"v-{k}") for k in {*keys} if k != "k7"] + [("unused", "v")]
    left = spark.createDataFrame(rows, "id int, k string")
    return rows, dict(table), left, spark.createDataFrame(table, "k string, v string")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("fits", [True, False])
def test_lookup_join_on_both_paths(sides, how, fits):
    rows, table, left, right = sides
    got = {(r["id"], r["k"], r["v"]) for r in lookup_join(left, right, ["k"], how, fits=fits).collect()}
    expected = {(i, k, table.get(k)) for i, k in rows if how == "left" or k in table}
    assert got == expected


def test_size_decides_the_path(sides, monkeypatch):
    _, _, left, right = sides
    assert "_salt" not in final_plan(lookup_join(left, right, ["k"]))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    plan = final_plan(lookup_join(left, right, ["k"]))
    assert "_salt" in plan and "Union" not in plan


def test_wide_rows_count_as_large(sides, monkeypatch):
    _, _, left, right = sides
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    assert "_salt" in final_plan(lookup_join(left, right, ["k"]))


def test_group_size(sides):
    rows, _, left, _ = sides
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    got = {r["id"]: r["group_size"] for r in with_group_size(left, ["k"]).collect()}
    assert got == {i: counts[k] for i, k in rows}


def test_remaining(spark):
    pool = spark.range(10).withColumnRenamed("id", "rec_id")
    picked = pool.where(F.col("rec_id") % 3 == 0)
    assert sorted(r[0] for r in remaining(pool, picked).collect()) == [1, 2, 4, 5, 7, 8]


def test_align_keeps_rows_without_partner(spark):
    gold = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, gold string")
    pred = spark.createDataFrame([(1, "B"), (2, "C")], "ord long, pred string")
    columns = ["ord", "gold", "pred", "in_gold", "in_pred"]
    got = [tuple(r) for r in align(gold, pred).select(columns).orderBy("ord").collect()]
    assert got == [(0, "a", None, True, False), (1, "b", "B", True, True), (2, None, "C", False, True)]
