"""Near leaks by prefix filtering against all pairs, and the Bloom filter."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audits, bloom, joins, near
from conftest import final_plan


def brute(rows, percent=80):
    found = {}
    for i, split, words in rows:
        mine = set(words)
        others = {s for _, s, w in rows if s != split and mine and w
                  and 100 * len(mine & set(w)) >= percent * len(mine | set(w))}
        if others:
            found[i] = (split, ",".join(sorted(others)))
    return found


def sample(rng, n, vocabulary, most):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = set(rng.choice(rows)[2])
            for _ in range(rng.randint(0, 3)):
                words ^= {rng.choice(vocabulary)}
        else:
            words = set(rng.choices(vocabulary, k=rng.randint(0, most)))
        rows.append((i, rng.choice(["train", "validation", "test"]), sorted(words)))
    return rows


@pytest.mark.parametrize("pairs, crowd", [(64, 1000), (0, 1000), (64, 3), (0, 2)])
def test_equals_all_pairs(spark, monkeypatch, pairs, crowd):
    monkeypatch.setattr(near, "PAIRS", pairs)
    monkeypatch.setattr(near, "CROWD", crowd)
    rng = random.Random(pairs + crowd)
    rows = sample(rng, 250, [f"w{int(rng.paretovariate(0.6))}" for _ in range(80)], 14)
    rows += [(1000 + i, s, ["only"]) for i, s in enumerate(["train", "test", "train"])]
    rows += [(1100, "train", ["a", "b"]), (1101, "test", ["a"]), (1200, "test", [])]
    df = spark.createDataFrame(rows, "rec_id int, split string, words array<string>")
    got = near.split_near_leaks(df, df["words"]).collect()
    assert {r["rec_id"]: (r["split"], r["splits"]) for r in got} == brute(rows)
    assert len(got) == len({r["rec_id"] for r in got})


@pytest.mark.parametrize("percent", [50, 95, 100])
def test_other_thresholds(spark, percent):
    rows = sample(random.Random(percent), 120, [f"w{i}" for i in range(25)], 10)
    df = spark.createDataFrame(rows, "rec_id int, split string, words array<string>")
    got = near.split_near_leaks(df, df["words"], percent=percent).collect()
    assert {r["rec_id"]: (r["split"], r["splits"]) for r in got} == brute(rows, percent)


def test_words_of_all_sets_are_no_keys(spark):
    """A frequent word becomes a key only of sets without rarer ones."""
    rows = [(f"d{i}", ["train"], ["the", "of", f"a{i}", f"b{i}", f"c{i}"]) for i in range(300)]
    rows.append(("hot", ["test"], ["of", "the"]))
    ranked = near._ranked(spark.createDataFrame(rows, "d string, splits array<string>, words array<string>"))
    keys = near._keys(ranked, 80, 1)
    assert keys.where("key IN ('the', 'of')").select("d").distinct().count() == 1
    counts, pairs = near._crowding(keys)
    assert pairs <= 2 * keys.count()


def test_no_all_pairs_join(spark):
    rows = sample(random.Random(1), 60, [f"w{i}" for i in range(30)], 8)
    df = spark.createDataFrame(rows, "rec_id int, split string, words array<string>")
    plan = final_plan(near.split_near_leaks(df, df["words"]))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_one_set_of_half_the_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = [(i, "train" if i % 3 else "test", ["a", "b", "c"]) for i in range(500)]
    rows += [(1000 + i, "train", [f"x{i}", "y"]) for i in range(500)]
    df = spark.createDataFrame(rows, "rec_id int, split string, words array<string>")
    assert near.split_near_leaks(df, df["words"]).count() == 500


def test_nothing(spark):
    df = spark.createDataFrame([], "rec_id int, split string, words array<string>")
    assert near.split_near_leaks(df, df["words"]).collect() == []
    nulls = spark.createDataFrame([(1, "train", None, None), (2, "test", "", None)], "rec_id int, split string, a string, b string")
    assert near.split_near_leaks(nulls, near.word_set(nulls["a"], nulls["b"])).collect() == []


# ---- Bloom filter ----

@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_filter_holds_its_keys_and_few_others(spark, n):
    key = lambda df: df.select(F.xxhash64("id").alias("a"), F.hash("id").alias("b"))
    size = bloom.bits(n)
    words = bloom.build(key(spark.range(n)), "a", "b", size).scalar()
    passed = lambda df: key(df).where(bloom.may_hold(words, F.col("a"), F.col("b"), size)).count()
    assert passed(spark.range(n)) == n
    others = 20_000
    assert passed(spark.range(10**6, 10**6 + others)) <= others * (2 * bloom.false_positives(n) + 0.002)


def test_size_is_bounded():
    assert bloom.bits(10**12) == bloom.MOST and bloom.bits(1000) == 16384
    assert bloom.false_positives(10**6) < 0.01 < bloom.false_positives(10**9)


def test_passages_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(n))
    wanted = [(i, say(rng.randint(3, 40))) for i in range(30)]
    docs = [(i, say(rng.randint(0, 60)) + (" " + rng.choice(wanted)[1] if i % 5 == 0 else "") + " " + say(5)) for i in range(200)]
    docs += [(500 + i, wanted[0][1]) for i in range(100)]
    df, other = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(wanted, "item int, text string")
    expected = sorted(r["id"] for r in audits.passage_leaks(df, other, "text", "id").collect())
    assert len(expected) > 100
    sent = []
    kept = audits.filtered
    monkeypatch.setattr(audits, "filtered", lambda w, k: sent.append((w.count(), kept(w, k))) or sent[-1][1])
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    got = sorted(r["id"] for r in audits.passage_leaks(df.where("id < 500"), other, "text", "id").collect())
    assert got == [i for i in expected if i < 500]
    before, after = sent[0][0], sent[0][1].count()
    assert before > 15_000 and after < before / 20


@pytest.mark.parametrize("fits", [True, False])
def test_audits_with_a_key_of_half_the_rows(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = [(i, "" if i % 2 else f"line {i}", "train" if i % 4 else "test") for i in range(800)]
    df = spark.createDataFrame(rows, "rec_id int, line string, split string")
    other = spark.createDataFrame([("",), ("line 4",), ("line 4",), (None,)], "line string")
    assert audits.leaks(df, other, ["line"], "rec_id").count() == 401
    twice = df.unionByName(df.withColumns({"rec_id": F.col("rec_id") + 1000, "split": F.lit("validation")}).where("rec_id < 1010"))
    got = audits.split_leaks(twice, ["line"]).collect()
    assert len(got) == 400 + 10 + 5
