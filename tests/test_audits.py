from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audits, results
from corpusloom.operators.joins import attach_evidence


def test_duplicates(spark):
    rows = [(1, "a", "b"), (2, "a", "b"), (3, "ab", ""), (4, "a", None), (5, "a", None), (6, "a", "")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    got = audits.duplicates(df, [F.col("x"), F.col("y")], "id").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (4, 2)]


def test_leaks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, t string")
    other = spark.createDataFrame([("a",), ("a",), ("c",)], "t string")
    assert sorted(r["id"] for r in audits.leaks(df, other, ["t"], "id").collect()) == [1, 4]


def test_passages_leak_inside_and_across_lines(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [
        (1, f"before it {item} and after it"),
        (2, item.replace("w7 ", "W7,\n").upper()),
        (3, "x " + " ".join(item.split()[4:17]) + " y"),
        (4, "x " + " ".join(item.split()[4:16]) + " y"),
        (5, "Thing.\nw0 w1"),
        (6, "so: One two three four; five six seven eight nine!"),
        (7, "one two three four five six seven eight"),
        (8, "Few words."),
        (9, "a few words more"),
        (10, None), (11, ""), (1, item),
    ]
    df = spark.createDataFrame(rows, "id int, t string")
    texts = [(item,), ("Thing.",), ("one two three four five six seven eight nine",), ("few words",), (None,), ("",)]
    other = spark.createDataFrame(texts, "t string")
    got = audits.passage_leaks(df, other, "t", "id").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 6, 8]
    assert audits.passage_leaks(df, other.limit(0), "t", "id").count() == 0


def test_split_leaks(spark):
    rows = [(1, "a", "train"), (2, "a", "test"), (3, "b", "train"), (4, "b", "train"), (5, "c", "test")]
    df = spark.createDataFrame(rows, "rec_id int, q string, split string")
    got = audits.split_leaks(df, ["q"]).collect()
    assert sorted(map(tuple, got)) == [(1, "train", "test,train"), (2, "test", "test,train")]


BAGS = {
    0: {0: "aab", 1: "aba", 2: "ab", 3: "aabb", 4: "ba"},
    1: {0: "x", 1: "y", 2: "y", 3: "x"},
    2: {0: "x", 1: "z"},
}


@pytest.fixture
def candidates(spark):
    rows = [(q, c, r) for q, cands in BAGS.items() for c, bag in cands.items() for r in bag]
    return spark.createDataFrame(rows, "question_id int, cand_idx int, row_json string")


def test_result_match(candidates):
    got = {(r["question_id"], r["cand_idx"]): r["matches"] for r in results.result_match(candidates).collect()}
    assert got == {
        (q, c): Counter(bag) == Counter(cands[0]) for q, cands in BAGS.items() for c, bag in cands.items() if c
    }


def test_vote_breaks_ties_by_the_earliest(candidates):
    got = {r["question_id"]: (r["cand_idx"], r["votes"]) for r in results.vote(candidates).collect()}
    assert got == {0: (2, 2), 1: (1, 2), 2: (1, 1)}


def test_evidence(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, question string")
    listed = spark.createDataFrame([("p", "see p"), ("r", "see r")], "question string, evidence string")
    got = {r["id"]: r["evidence"] for r in attach_evidence(df, listed).collect()}
    assert got == {1: "see p", 2: None, 3: None}
    with pytest.raises(Exception, match="listed twice for p"):
        attach_evidence(df, listed.union(listed)).collect()
