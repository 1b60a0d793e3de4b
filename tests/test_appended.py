"""Sources appended to what was sampled, split, deduplicated and profiled before."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedupe, scoring, sketches, split
from corpusloom.operators.ordering import with_shuffle_key
from corpusloom.operators.quota import quota_fill
from conftest import final_plan


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed, cap, size", [(1, 2, 40), (2, 5, 90)])
def test_quota_sample_from_states(spark, seed, cap, size):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcd"), rng.choice(["g1", "g2", "g3", None, *[f"h{k}" for k in range(30)]])) for i in range(600)]
    quotas = {"a": 12, "b": 0, "c": 30, "d": 7}
    pool = with_shuffle_key(spark.createDataFrame(rows, "rec_id int, bucket string, db_id string"), seed)
    whole = quota_fill(pool, quotas, cap=cap).top_up(size).picks
    state = None
    for lo, hi in ((0, 50), (50, 400), (400, 600)):
        new = pool.where((F.col("rec_id") >= lo) & (F.col("rec_id") < hi))
        state = quota_fill(new if state is None else state.unionByName(new), quotas, cap=cap).top_up(size).state()
    assert state.count() < 0.7 * 600
    picks = quota_fill(state, quotas, cap=cap).top_up(size).picks
    assert rows_of(picks, "rec_id", "pick_pass") == rows_of(whole, "rec_id", "pick_pass")


@pytest.mark.parametrize("seed", [1])
def test_split_keeps_labels_and_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "x", "x", "y", None, f"z{i % 40}"])) for i in range(900)]
    df = spark.createDataFrame(rows, "rec_id int, source string")
    first = split.stratified_split(df.where("rec_id < 300"), ["source"], seed).select("rec_id", "source", "split")
    labels = {r["rec_id"]: r["split"] for r in first.collect()}
    counts = split.split_counts(first, ["source"])
    for lo, hi in ((300, 301), (301, 500), (500, 900)):
        part = df.where((F.col("rec_id") >= lo) & (F.col("rec_id") < hi))
        more, counts = split.split_appended(part, counts, ["source"], seed)
        found = {r["rec_id"]: r["split"] for r in more.collect()}
        assert not set(found) & set(labels) and len(found) == hi - lo
        labels |= found
    for source in {s for _, s in rows}:
        n = held = 0
        had = {"test": 0, "validation": 0}
        for lo, hi in ((0, 300), (300, 301), (301, 500), (500, 900)):
            new = [i for i, s in rows if s == source and lo <= i < hi]
            n, room = n + len(new), len(new)
            share = max(1, round(n * 0.1)) if n >= 3 else 0
            for name in had:
                paid = min(room, max(0, share - had[name]))
                had[name], room = had[name] + paid, room - paid
        given = [labels[i] for i, s in rows if s == source]
        assert {name: given.count(name) for name in had} == had, source
        # all that is owed is paid where the rows last added suffice
        held += had == {"test": share, "validation": share}
        assert held or len(given) < 30, source


def test_kept_keys(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", *"abcdefgh", *map(str, range(200))]), rng.randint(0, 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "rec_id int, text string, part int")
    keys = {"t": F.col("text")}
    kept = dedupe.KeptKeys(spark, "kept_test", str(tmp_path / "kept"), 4)
    got, seen = [], set()
    for k in range(3):
        part = df.where(F.col("part") == k)
        if k == 2:
            lines = final_plan(kept.fresh(part, keys, "rec_id")).split("Initial Plan")[0].splitlines()
            old = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "kept_test" in line)
            join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
            # from the join down the old side is a sorted scan only
            depth = lines[old].index("FileScan")
            above = []
            for line in reversed(lines[join + 1 : old]):
                at = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if at < depth:
                    above.append(line)
                    depth = at
            assert above and not any("Exchange" in line for line in above), above
            # a new session-wide handle reads the same folder
            kept = dedupe.KeptKeys(spark, "kept_again", str(tmp_path / "kept"), 4)
        found = kept.append(part, keys, "rec_id").collect()
        expected = {}
        for i, text, p in rows:
            if p == k and text not in seen:
                expected.setdefault(text, i)
        seen |= set(expected)
        assert sorted((r["rec_id"]) for r in found) == sorted(expected.values())
        got += found
    assert len(got) == len({text for _, text, _ in rows})
    for name in ("kept_test", "kept_again"):
        spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def lengths(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"v{rng.randint(0, 3000)}", rng.choice([0, 1, 2, None, int(rng.paretovariate(0.5))]))
            for _ in range(6000)]
    return rows, spark.createDataFrame(rows, "source string, value string, chars long")


def test_profiles_merge_in_any_order(spark, lengths):
    rows, df = lengths
    parts = [sketches.profile(p, "source", "value", "chars") for p in df.randomSplit([1.0, 2.0, 3.0], 5)]
    one = sketches.read(sketches.merge(*parts, by="source"), "source")
    other = sketches.read(sketches.merge(sketches.merge(parts[2], parts[0], by="source"), parts[1], by="source"), "source")
    whole = sketches.read(sketches.profile(df, "source", "value", "chars"), "source")
    assert rows_of(one, *one.columns) == rows_of(other, *one.columns) == rows_of(whole, *one.columns)


def test_profiles_within_their_error(spark, lengths):
    rows, df = lengths
    merged = sketches.profile(df, "source", "value", "chars")
    for r in sketches.read(merged.unionByName(sketches.total(merged, "source", "all")), "source").collect():
        mine = [x for x in rows if r["source"] == "all" or x[0] == r["source"]]
        sizes = sorted(c for _, _, c in mine if c is not None)
        assert r["n"] == len(mine) and r["longest"] == sizes[-1]
        assert abs(r["different"] / len({v for _, v, _ in mine}) - 1) < 0.03
        for name, place in (("p50", (len(sizes) - 1) // 2), ("p90", int(0.9 * len(sizes)))):
            assert abs(r[name] - sizes[place]) <= 0.01 * sizes[place] + 0.5


def test_empty_profiles(spark, lengths):
    _, df = lengths
    none = sketches.profile(df.limit(0), "source", "value", "chars")
    full = sketches.profile(df, "source", "value", "chars")
    assert sketches.read(none, "source").collect() == []
    both = sketches.read(sketches.merge(none, full, by="source"), "source")
    assert rows_of(both, *both.columns) == rows_of(sketches.read(full, "source"), *both.columns)


# ---- scores with intervals ----

def test_poisson_weights(spark):
    weights = spark.range(200_000).select(scoring._weight(F.md5(F.col("id").cast("string")), 1).alias("w"))
    mean, var = weights.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 0.01 and abs(var - 1) < 0.02


def test_scores_by_tier(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["easy", "hard", None]), rng.random() < 0.9, rng.choice([True, False, None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "rec_id int, tier string, parse_ok boolean, em boolean")
    got = scoring.score_by_tier(df.repartition(7), "tier").collect()
    again = scoring.score_by_tier(df.coalesce(1), "tier").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == 4
    for r in got:
        mine = [x for x in rows if r["is_total"] or x[1] == r["tier"]]
        assert (r["n"], r["parse_ok"], r["em"]) == (len(mine), sum(x[2] for x in mine), sum(bool(x[3]) for x in mine))
        rate = r["normalized_em"]
        half = 1.96 * (rate * (1 - rate) / r["n"]) ** 0.5
        assert r["em_low"] < rate < r["em_high"]
        assert (r["em_high"] - r["em_low"]) / 2 == pytest.approx(half, rel=0.35)


def test_scores_of_nothing(spark):
    assert scoring.score_by_tier(spark.createDataFrame([], "rec_id int, tier string, parse_ok boolean, em boolean"), "tier").collect() == []
