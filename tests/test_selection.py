import random

import models
import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from corpusloom.operators import ordering, quota
from corpusloom.operators.dedupe import dedupe_first, dedupe_paraphrases, text_key
from corpusloom.operators.ordering import with_shuffle_key
from corpusloom.operators.quota import fill_counts, quota_fill


def make_pool(spark, seed, n=600):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["d0"] * 5 + [f"d{j}" for j in range(9)]), rng.choice("aaabbcd"))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "rec_id long, db_id string, bucket string")
    rows.sort(key=lambda r: (models.key(11, r[0]), r[0]))
    return rows, with_shuffle_key(df, 11)


def in_pick_order(picks):
    ordered = picks.orderBy("pick_pass", "shuffle_key", "rec_id")
    return [r["rec_id"] for r in ordered.collect()]


@pytest.mark.parametrize("cap, quotas, size", [
    (12, {"a": 20, "b": 15, "c": 10, "d": 0}, None),
    (12, {"a": 20, "b": 15, "c": 10, "d": 0}, 70),
    (3, {"b": 10, "a": 30, "zzz": 5}, 27),
    (1, {"a": 2, "b": 9}, 9),
    (9, {"a": 0, "b": 0}, 40),
    (200, {"d": 60, "c": 500, "a": 30}, 400),
])
def test_quota_fill_equals_the_greedy_loop(spark, cap, quotas, size):
    rows, pool = make_pool(spark, cap)
    sample = quota_fill(pool, quotas, cap=cap)
    if size is not None:
        sample = sample.top_up(size)
    expected = models.greedy(rows, quotas, cap, size)
    assert in_pick_order(sample.picks) == expected
    assert sample.size == len(expected)
    short = [r["rec_id"] for r in sample.head(17).collect()]
    assert short == expected[:17]


def test_large_quotas_are_cut_by_cells(spark, monkeypatch):
    rows, pool = make_pool(spark, 1)
    expected = models.greedy(rows, {"a": 50, "b": 20}, 40, 90)
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", 30)
    spark.conf.set(name, 10)
    try:
        sample = quota_fill(pool, {"a": 50, "b": 20}, cap=40).top_up(90)
        assert in_pick_order(sample.picks) == expected
        assert {r["rec_id"] for r in sample.head(60).collect()} == set(expected[:60])
    finally:
        spark.conf.unset(name)


def test_heads_hold_all_that_the_sequence_touches():
    """The bounds of the module's text against the whole greedy loop."""
    rng = random.Random(3)
    for _ in range(2000):
        n, cap = rng.randint(1, 40), rng.randint(1, 5)
        rows = [(i, rng.choice("xxyz"), rng.choice("aab")) for i in range(n)]
        quotas = {b: rng.randint(0, 8) for b in rng.sample("abc", 3)}
        size = rng.choice([None, rng.randint(0, 20)])
        heads, before, number = [], 0, 0

        def reachable(some):
            seen, out = {}, []
            for r in some:
                seen[r[1]] = seen.get(r[1], 0) + 1
                if seen[r[1]] <= cap:
                    out.append(r)
            return out

        for name, wanted in quotas.items():
            if wanted > 0:
                before += wanted
                own = reachable([r for r in rows if r[2] == name])[:before]
                heads += [(number, r[0], r[1]) for r in own]
                number += 1
        if size:
            heads += [(number, r[0], r[1]) for r in reachable(rows)[: max(size, before)]]
        found = [i for i, _ in quota.greedy_picks(heads, quotas, cap, size)]
        assert found == models.greedy(rows, quotas, cap, size)


def test_jobs_per_sample(spark):
    _, pool = make_pool(spark, 1)
    pool = pool.cache()
    pool.count()
    group = "quota-jobs"
    spark.sparkContext.setJobGroup(group, "count")
    quota_fill(pool, {"a": 20, "b": 15, "c": 10}, cap=7).top_up(55).picks
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 12


@pytest.mark.parametrize("cap", [1, 4, 60])
def test_large_groups_are_cut_before_they_are_ranked(spark, monkeypatch, cap):
    rows, pool = make_pool(spark, 2)
    assert quota._cut_large_groups(pool, ["bucket", "db_id"], cap, "rec_id") is pool
    monkeypatch.setattr(ordering, "ROWS_PER_CELL", 5)
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, 0)
    cut = quota._cut_large_groups(pool, ["bucket", "db_id"], cap, "rec_id")
    spark.conf.unset(name)
    sizes, kept = {}, {}
    for row_id, db, bucket in rows:
        sizes.setdefault((bucket, db), []).append(row_id)
    for r in cut.collect():
        kept.setdefault((r["bucket"], r["db_id"]), set()).add(r["rec_id"])
    assert cut.columns == pool.columns
    assert kept == {
        k: set(ids[:cap] if len(ids) > 5 else ids) for k, ids in sizes.items()
    }


def test_no_group_above_the_cap_and_counts(spark):
    _, pool = make_pool(spark, 4)
    picks = quota_fill(pool, {"a": 20, "b": 15, "c": 10}, cap=7).top_up(55).picks
    assert picks.groupBy("db_id").count().agg(F.max("count")).first()[0] <= 7
    counts = {r["bucket"]: r["n"] for r in fill_counts(picks).collect()}
    assert sum(counts.values()) == picks.count() == 55


def test_no_quota_gives_no_rows(spark):
    _, pool = make_pool(spark, 4)
    sample = quota_fill(pool, {"a": 0}, cap=7)
    assert sample.picks.count() == 0 and sample.head(5).count() == 0


def test_dedupe_keeps_the_first_in_input_order(spark):
    rows = [(3, "d", "SELECT a", "q3"), (1, "d", "select A", "q1"), (2, "e", "select a", "q2"),
            (4, "d", "select b", "q4")]
    df = spark.createDataFrame(rows, "rec_id long, db_id string, sql string, question string")
    got = {r["rec_id"]: r["question"] for r in dedupe_paraphrases(df).collect()}
    assert got == {1: "q1", 2: "q2", 4: "q4"}


def test_dedupe_limits_groups_before_the_shuffle(spark):
    text = F.when(F.col("id") < 990, "same").otherwise(F.col("id").cast("string"))
    df = spark.range(1000).withColumn("text", text)
    kept = dedupe_first(df, {"text": text_key(F.col("text"))}, "id")
    plan = final_plan(kept)
    assert {r["id"] for r in kept.collect()} == {0, *range(990, 1000)}
    # printed from the top: the partial limit stands below the exchange
    assert plan.index("Exchange hashpartitioning") < plan.index("row_number(), 1, Partial")
