import random

import models
import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from corpusloom.operators import ordering
from corpusloom.operators.ordering import (
    head, in_order, label_by_rank, rows_before, take_first, with_position, with_shuffle_key,
)


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows; one stratum holds more than a third, one is null."""
    rng = random.Random(5)
    data = [
        (i, rng.choice(["hot"] * 6 + ["a", "b", "c", None, "d"]), rng.choice("xy"))
        for i in range(2000)
    ]
    data += [(5000, "single", "x"), (5001, "pair", "x"), (5002, "pair", "x")]
    return spark.createDataFrame(data, "rec_id long, g string, h string")


def by_group(rows):
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["g"], r["h"]), []).append(r["rec_id"])
    return {g: sorted(ids, key=lambda i: (models.key(7, i), i)) for g, ids in groups.items()}


@pytest.mark.parametrize("per_cell", [1, 30, 1_000_000])
def test_label_by_rank_is_exact(spark, rows, monkeypatch, per_cell):
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", per_cell)
    cuts = {"first": lambda n: F.floor(n / 3), "second": lambda n: F.floor(n / 2) + 1}
    got = label_by_rank(with_shuffle_key(rows, 7), ["g", "h"], cuts, "rest")
    labels = {r["rec_id"]: r["label"] for r in got.collect()}
    expected = {}
    for ids in by_group(rows).values():
        n = len(ids)
        for place, i in enumerate(ids):
            expected[i] = (
                "first" if place < n // 3 else "second" if place < n // 2 + 1 else "rest"
            )
    assert labels == expected


def test_labelling_does_not_shuffle_the_rows(spark, rows):
    wide = with_shuffle_key(rows, 7).withColumn("text", F.lit("long"))
    got = label_by_rank(wide, ["g"], {"in": lambda n: F.lit(5)}, "out")
    plan = final_plan(got)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("k", [0, 1, 777, 5000])
def test_take_first_by_cells_equals_limit(spark, rows, monkeypatch, k):
    keyed = with_shuffle_key(rows, 7)
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", 100)
    limited = {r["rec_id"] for r in take_first(keyed, k).collect()} if k <= 1000 else None
    monkeypatch.setattr(ordering, "SMALL_LIMIT", -1)
    got = {r["rec_id"] for r in take_first(keyed, k).collect()}
    ids = sorted((r["rec_id"] for r in rows.collect()), key=lambda i: (models.key(7, i), i))
    assert got == set(ids[:k])
    assert limited is None or limited == got


@pytest.mark.parametrize("per_cell", [1, 20, 1_000_000])
def test_position_is_dense(spark, rows, monkeypatch, per_cell):
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", per_cell)
    keyed = with_shuffle_key(rows, 7).withColumn("major", F.when(F.col("h") == "x", 2).otherwise(1))
    got = with_position(keyed, "major").orderBy("position").collect()
    expected = sorted(
        rows.collect(), key=lambda r: (2 if r["h"] == "x" else 1, models.key(7, r["rec_id"]))
    )
    assert [r["position"] for r in got] == list(range(len(expected)))
    assert [r["rec_id"] for r in got] == [r["rec_id"] for r in expected]


def test_order_does_not_depend_on_partitioning(spark, rows):
    cuts = {"in": lambda n: F.floor(n / 4)}

    def run(df):
        return {
            (r["rec_id"], r["label"])
            for r in label_by_rank(with_shuffle_key(df, 7), ["g"], cuts, "out").collect()
        }

    assert run(rows.repartition(1)) == run(rows.repartition(8, "h"))


def test_head(spark, rows):
    assert [r["rec_id"] for r in head(rows, 3, "rec_id").collect()] == [0, 1, 2]


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_in_order_ranges_without_sampling(spark, rows, partitions):
    keyed = with_shuffle_key(rows, 7).withColumn("major", F.when(F.col("h") == "x", 2).otherwise(1))
    sizes = dict(map(tuple, keyed.groupBy("major").count().collect()))
    moved = in_order(keyed, "major", sizes, partitions).sortWithinPartitions("major", "shuffle_key")
    placed = moved.select("major", "shuffle_key", F.spark_partition_id().alias("p")).collect()
    in_file_order = [(r["major"], r["shuffle_key"]) for r in sorted(placed, key=lambda r: r["p"])]
    assert in_file_order == sorted(in_file_order) and len(placed) == rows.count()
    largest = max(sum(r["p"] == p for r in placed) for p in {r["p"] for r in placed})
    assert largest < 1.5 * rows.count() / partitions + 50


def test_rows_before_moves_no_rows(spark):
    """Counts of the partitions that in_order makes, without moving rows there."""
    keyed = with_shuffle_key(spark.range(3000).withColumn("major", (F.col("id") % 3).cast("int")), 5, "id")
    keyed = keyed.where((F.col("major") > 0) | (F.col("id") < 30)).withColumn("wide", F.repeat(F.lit("x"), 1000))
    sizes = {r["major"]: r["count"] for r in keyed.groupBy("major").count().collect()}
    moved = in_order(keyed, "major", sizes, 9)
    counts = dict(moved.groupBy(F.spark_partition_id()).count().collect())
    ahead = {r["_target"]: r["_ahead"] for r in rows_before(keyed, "major", sizes, 9).collect()}
    assert ahead == {t: sum(n for other, n in counts.items() if other < t) for t in counts}
    assert rows_before(keyed.limit(0), "major", {}, 9).count() == 0
