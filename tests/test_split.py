import random

import models
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.split import (
    SPLITS, merged_order, share, stratified_split, union_splits,
)
from corpusloom.operators.stats import split_stats, split_summary

# Published sizes of the 15 strata of the two sources, and what each split got per bucket.
STRATA = {
    "first": {"group_by": 26, "having": 4, "multi_join": 109, "nested": 36, "set_op": 1,
              "simple": 43, "single_join": 221, "single_table_analytic": 60},
    "second": {"group_by": 80, "having": 70, "multi_join": 100, "nested": 90, "set_op": 50,
               "single_join": 60, "single_table_analytic": 50},
}
TRAIN = {"having": 58, "single_join": 225, "nested": 100, "group_by": 84,
         "single_table_analytic": 88, "simple": 35, "multi_join": 167, "set_op": 41}
HELD_OUT = {"having": 8, "single_join": 28, "nested": 13, "group_by": 11,
            "single_table_analytic": 11, "simple": 4, "multi_join": 21, "set_op": 5}


def test_published_split(spark):
    rows = [(s, b) for s, sizes in STRATA.items() for b, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(rows)], "rec_id long, source string, bucket string"
    )
    stats = split_stats(stratified_split(df, ["source", "bucket"])).collect()
    got = {(r["dimension"], r["split"], r["source"], r["bucket"]): r["n"] for r in stats}
    expected = {("merged", None, None, None): 1000, ("source", None, "first", None): 500,
                ("source", None, "second", None): 500}
    expected |= {("split", s, None, None): n for s, n in zip(SPLITS, (798, 101, 101))}
    for b, n in TRAIN.items():
        expected[("bucket", None, None, b)] = n + 2 * HELD_OUT[b]
        expected[("split_bucket", "train", None, b)] = n
        for held_out in SPLITS[1:]:
            expected[("split_bucket", held_out, None, b)] = HELD_OUT[b]
    assert got == expected


def test_published_summary(spark):
    rows = [(s, b) for s, sizes in STRATA.items() for b, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(
        [(i, s, b) for i, (s, b) in enumerate(rows)], "rec_id long, source string, bucket string"
    )
    got = split_summary(split_stats(stratified_split(df, ["source", "bucket"]))).first().asDict()
    assert got == {
        "counts": {"merged": 1000, "train": 798, "validation": 101, "test": 101},
        "by_source": {"first": 500, "second": 500},
        "by_bucket": {b: n + 2 * HELD_OUT[b] for b, n in TRAIN.items()},
        "train_by_bucket": TRAIN,
        "val_by_bucket": HELD_OUT,
        "test_by_bucket": HELD_OUT,
    }


def test_share_rounds_like_python(spark):
    df = spark.range(0, 20000).select("id", *[
        share(F.col("id"), f).alias(str(i)) for i, f in enumerate((0.1, 0.15, 0.25, 0.5))
    ])
    for row in df.collect():
        n = row["id"]
        for i, f in enumerate((0.1, 0.15, 0.25, 0.5)):
            assert row[str(i)] == (max(1, round(n * f)) if n >= 3 else 0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [(f"r{i}", rng.choice(["hot"] * 8 + [f"s{j}" for j in range(30)])) for i in range(1500)]
    return data, spark.createDataFrame(data, "rec_id string, stratum string")


@pytest.mark.parametrize("val, test", [(0.1, 0.1), (0.5, 0.5), (0.0, 0.3)])
def test_split_equals_model_and_window(rows, val, test):
    data, df = rows
    expected = models.split(data, val, test, 42)
    for operator in (stratified_split, models.stratified_split_by_window):
        got = operator(df, ["stratum"], 42, val, test)
        assert {r["rec_id"]: r["split"] for r in got.collect()} == expected


def test_split_does_not_depend_on_partitioning(rows):
    _, df = rows
    one, many = [
        stratified_split(df.repartition(n), ["stratum"]).select("rec_id", "split") for n in (1, 7)
    ]
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_splits_partition_the_input(rows):
    _, df = rows
    labelled = stratified_split(df, ["stratum"]).select("rec_id", "stratum", "split")
    parts = {s: labelled.where(F.col("split") == s).drop("split") for s in SPLITS}
    merged = union_splits(parts).drop("split")
    assert merged.exceptAll(df).isEmpty() and df.exceptAll(merged).isEmpty()


def test_merged_order(rows):
    _, df = rows
    labelled = stratified_split(df, ["stratum"]).select("rec_id", "split")
    ordered = merged_order(labelled, 43).orderBy("position").collect()
    assert [r["position"] for r in ordered] == list(range(1500))
    assert [r["rec_id"] for r in ordered] == [
        r["rec_id"] for r in sorted(
            ordered, key=lambda r: (SPLITS.index(r["split"]), models.key(43, r["rec_id"])))
    ]
