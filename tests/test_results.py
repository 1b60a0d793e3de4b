"""Results as bags, with columns in a fixed or any order."""

import random
from collections import Counter
from itertools import permutations

import pytest

from corpusloom.operators import joins, results
from conftest import final_plan

SCHEMA = "question_id int, cand_idx int, row_json string"


def bags(rows):
    out = {}
    for q, c, row in rows:
        out.setdefault((q, c), Counter())[row] += 1
    return out


def sample(rng):
    rows = []
    for q in range(25):
        gold = [f"r{rng.randint(0, 3)}" for _ in range(rng.randint(1, 6))]
        for c in range(5):
            bag = list(gold)
            if c and rng.random() < 0.5:
                bag[rng.randrange(len(bag))] = f"r{rng.randint(0, 3)}"
            rng.shuffle(bag)
            rows += [(q, c, r) for r in bag]
    return rows + [(99, 1, "no gold"), (98, 0, "no answer"), (97, 0, None), (97, 1, None), (97, 2, "")]


@pytest.mark.parametrize("fits", [True, False])
def test_match_and_vote(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    rows = sample(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = bags(rows)
    got = {(r["question_id"], r["cand_idx"]): r["matches"] for r in results.result_match(df).collect()}
    assert got == {(q, c): found.get((q, 0)) == bag for (q, c), bag in found.items() if c}
    votes = {r["question_id"]: (r["cand_idx"], r["votes"]) for r in results.vote(df).collect()}
    for q in {q for q, c in found if c}:
        answers = {c: frozenset(bag.items()) for (p, c), bag in found.items() if p == q and c}
        counts = Counter(answers.values())
        best = min((c for c in answers if counts[answers[c]] == max(counts.values())))
        assert votes[q] == (best, max(counts.values()))


def test_a_result_of_most_rows_is_added_up_before_the_shuffle(spark):
    rows = spark.range(300_000).selectExpr(
        "CAST(IF(id % 10 = 0, id % 7, 50) AS int) AS question_id", "CAST(id % 2 AS int) AS cand_idx",
        "CAST(id div 2 AS string) AS row_json")
    plan = final_plan(results.results(rows)).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan and "collect_" not in plan
    assert {r["matches"] for r in results.result_match(rows.where("question_id = 50")).collect()} == {False}


def table(rng, columns, rows):
    return [tuple(rng.choice(["a", "b", None, ""]) for _ in range(columns)) for _ in range(rows)]


def same_up_to_columns(a, b):
    width = {len(r) for r in a + b}
    if len(width) != 1:
        return False
    return any(Counter(tuple(r[j] for j in p) for r in a) == Counter(b) for p in permutations(range(width.pop())))


@pytest.mark.parametrize("seed", range(4))
def test_columns_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for q in range(25):
        columns = rng.randint(1, 4)
        gold = table(rng, columns, rng.randint(1, 5))
        if rng.random() < 0.4 and columns > 1:
            gold = [(*r[:-1], r[0]) for r in gold]
        rows += [(q, 0, list(r)) for r in gold]
        for c in range(1, 5):
            p = list(range(columns))
            rng.shuffle(p)
            bag = [tuple(r[j] for j in p) for r in gold]
            if rng.random() < 0.5:
                i, j = rng.randrange(len(bag)), rng.randrange(columns)
                k = rng.randrange(len(bag))
                swapped = [list(r) for r in bag]
                swapped[i][j], swapped[k][j] = swapped[k][j], swapped[i][j]
                bag = [tuple(r) for r in swapped]
            rng.shuffle(bag)
            rows += [(q, c, list(r)) for r in bag]
            expected[q, c] = same_up_to_columns(bag, gold)
    df = spark.createDataFrame(rows, "question_id int, cand_idx int, cells array<string>").repartition(3)
    got = results.result_match_columns(df).collect()
    assert {(r["question_id"], r["cand_idx"]): r["matches"] for r in got} == expected
    assert len(got) == len(expected) and set(expected.values()) == {True, False}


def test_columns_that_digests_cannot_tell_apart(spark):
    """A cycle of six against two of three, as pairs: alike for every column digest."""
    one = [(i, (i + 1) % 6) for i in range(6)]
    two = [(i, (i + 1) % 3) for i in range(3)] + [(3 + i, 3 + (i + 1) % 3) for i in range(3)]
    as_columns = lambda edges: [["1" if v in e else "0" for v in range(6)] for e in edges]
    turned = [[r[j] for j in (3, 5, 0, 2, 4, 1)] for r in as_columns(one)]
    rows = [(1, 0, r) for r in as_columns(one)] + [(1, 1, r) for r in as_columns(two)] + [(1, 2, r) for r in turned]
    df = spark.createDataFrame(rows, "question_id int, cand_idx int, cells array<string>")
    got = {r["cand_idx"]: r["matches"] for r in results.result_match_columns(df).collect()}
    assert got == {1: False, 2: True}


def test_too_many_orders_fail(spark):
    wide = [[["1" if v in (i, (i + 1) % 9) else "0" for v in range(9)] for i in range(9)]]
    other = [["1" if v in e else "0" for v in range(9)] for e in
             [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 7), (7, 8), (8, 6)]]
    rows = [(1, 0, r) for r in wide[0]] + [(1, 1, r) for r in other]
    df = spark.createDataFrame(rows, "question_id int, cand_idx int, cells array<string>")
    with pytest.raises(Exception, match="orders of columns"):
        results.result_match_columns(df).collect()


def test_one_column_many_times_is_one_column(spark):
    rows = [(1, c, [str(i)] * 12 + ["z"]) for c in (0, 1) for i in range(4)] + [(1, 2, ["z"] + [str(i)] * 12) for i in range(4)]
    df = spark.createDataFrame(rows, "question_id int, cand_idx int, cells array<string>")
    assert {r["matches"] for r in results.result_match_columns(df).collect()} == {True}


def test_no_rows(spark):
    assert results.result_match(spark.createDataFrame([], SCHEMA)).collect() == []
    assert results.result_match_columns(spark.createDataFrame([], "question_id int, cand_idx int, cells array<string>")).collect() == []
