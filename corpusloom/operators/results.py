"""Result sets of candidate answers: match against gold, and vote.

Results are bags of rows in a table ``question_id, cand_idx, row_json``; gold is
candidate 0. A bag is compared by an order-free digest: sums over its rows of two
independent 64-bit hashes, and their number. Sums add up before the shuffle, so a
result is one small row per task however many rows it has, and no result is
gathered. Where the order of columns is free, a row is an array and each column
has such a digest too.
"""

from __future__ import annotations

import sys
from itertools import permutations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

# executors get the function below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GOLD = 0
RESULT = ["question_id", "cand_idx"]


def bag_digest(*row: Column) -> Column:
    """Digest of a bag of rows, whatever their order: an aggregate. The hashes are
    added in halves, so sums are exact below two billion rows and fail above."""
    parts = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *row)
        parts += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.struct(F.count(F.lit(1)).alias("n"), *[p.alias(f"h{i}") for i, p in enumerate(parts)])


def results(candidates: DataFrame) -> DataFrame:
    """``question_id, cand_idx, result``: a digest per result."""
    return candidates.groupBy(*RESULT).agg(bag_digest(F.col("row_json")).alias("result"))


def result_match(candidates: DataFrame) -> DataFrame:
    """``question_id, cand_idx, matches`` for all candidates but gold."""
    return _matched(stage(results(candidates)))


def _matched(found: DataFrame) -> DataFrame:
    gold = found.where(F.col("cand_idx") == GOLD).select("question_id", F.col("result").alias("wanted"))
    answers = found.where(F.col("cand_idx") != GOLD)
    pairs = lookup_join(answers, gold, ["question_id"], "left")
    return pairs.select(*RESULT, F.coalesce(F.col("result") == F.col("wanted"), F.lit(False)).alias("matches"))


def vote(candidates: DataFrame) -> DataFrame:
    """``question_id, cand_idx, votes``: the result that most candidates share,
    named by its first candidate; of equal ones the one with the earliest."""
    groups = results(candidates.where(F.col("cand_idx") != GOLD)).groupBy("question_id", "result").agg(
        F.count(F.lit(1)).alias("votes"), F.min("cand_idx").alias("cand_idx")
    )
    best = groups.groupBy("question_id").agg(
        F.max(F.struct("votes", (-F.col("cand_idx")).alias("earliest"))).alias("best")
    )
    return best.select(
        "question_id", (-F.col("best.earliest")).alias("cand_idx"), F.col("best.votes").alias("votes")
    )


# ---- any order of columns ----

# Orders of columns that are alike which are tried before the job fails.
ORDERS = 5040


def _cells(cells: Column) -> Column:
    """Cells as texts that tell null from empty."""
    return F.transform(cells, lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-")))


def _signatures(rows: DataFrame, *context: str) -> DataFrame:
    """``question_id, cand_idx, columns``: per column the digest of its values
    (each with the row's context), in the columns' order."""
    each = rows.select(*RESULT, *context, F.posexplode("cells").alias("at", "value"))
    found = each.groupBy(*RESULT, "at").agg(bag_digest(F.col("value"), *map(F.col, context)).alias("s"))
    # as long as a row is wide
    return found.groupBy(*RESULT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda c: c["s"]).alias("columns")
    )


def _in_order(placed: DataFrame, *more: str) -> DataFrame:
    """Digest of each result with its columns in the order of ``order``."""
    cells = F.transform("order", lambda j: F.coalesce(F.get("cells", j), F.lit("")))
    return placed.select(*RESULT, *more, cells.alias("row")).groupBy(*RESULT, *more).agg(
        bag_digest(F.col("row")).alias("result")
    )


def _orders(ranks: list[int], classes: list[int]) -> list[list[int]]:
    """All orders of columns by rank that differ: columns of one rank in any
    order, but those of one class, which are the same column, in one."""
    out: list[list[int]] = [[]]
    for rank in sorted(set(ranks)):
        tied = [j for j, r in enumerate(ranks) if r == rank]
        seen: dict[tuple[int, ...], tuple[int, ...]] = {}
        for order in permutations(tied):
            seen.setdefault(tuple(classes[j] for j in order), order)
            if len(seen) * len(out) > ORDERS:
                raise ValueError(f"more than {ORDERS} orders of columns that are alike")
        out = [done + list(order) for done in out for order in seen.values()]
    return out


def result_match_columns(candidates: DataFrame) -> DataFrame:
    """``question_id, cand_idx, matches``: whether a candidate's rows (``cells``, an
    array) are gold's for some order of its columns.

    A column is known by the digest of its values, then of its values each with
    the digest of its row's cells, in any order. Columns in the order of these
    digests are compared with gold's. Columns that are alike to that point are
    tried in every order, unless they are one column twice.
    """
    rows = stage(candidates.select(*RESULT, _cells(F.col("cells")).alias("cells")))
    first = lookup_join(rows, _signatures(rows), RESULT)
    around = F.xxhash64(F.array_sort(F.transform("cells", lambda v, j: F.xxhash64(F.get("columns", j), v))))
    refined = stage(_signatures(first.select(*RESULT, "cells", around.alias("around")), "around"))
    named = refined.select(*RESULT, "columns", F.array_sort("columns").alias("sorted"))
    order = F.transform(
        F.array_sort(F.transform("columns", lambda s, j: F.struct(s.alias("s"), j.alias("j")))), lambda c: c["j"]
    )
    ordered = _in_order(lookup_join(rows, named.select(*RESULT, order.alias("order")), RESULT))
    found = stage(ordered.join(named.select(*RESULT, "sorted", "columns"), RESULT))
    gold = found.where(F.col("cand_idx") == GOLD).select(
        "question_id", F.col("result").alias("wanted"), F.col("sorted").alias("gold_sorted")
    )
    pairs = stage(lookup_join(found.where(F.col("cand_idx") != GOLD), gold, ["question_id"], "left"))
    same = F.coalesce(F.col("result") == F.col("wanted"), F.lit(False))
    alike = F.coalesce(F.col("sorted") == F.col("gold_sorted"), F.lit(False))
    tied = F.size(F.array_distinct("columns")) < F.size("columns")
    open_ = stage(pairs.where(alike & ~same & tied).select(*RESULT, "columns", "wanted"))
    settled = pairs.where(~(alike & ~same & tied)).select(*RESULT, (alike & same).alias("matches"))

    # pairs of alike columns that differ in no row are one column
    ranks = F.transform("columns", lambda s: F.array_position(F.array_distinct("columns"), s).cast("int"))
    looked = lookup_join(rows, open_.select(*RESULT, "columns"), RESULT)
    places = F.sequence(F.lit(0), F.size("columns") - 1)
    couples = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(places, lambda j: (j > i) & (F.get("columns", i) == F.get("columns", j))),
        lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("cells", i) != F.get("cells", j)).alias("other")),
    )))
    differ = looked.select(*RESULT, F.inline(couples)).groupBy(*RESULT, "i", "j").agg(F.count_if("other").alias("n"))
    twins = differ.where(F.col("n") == 0).groupBy(*RESULT, "j").agg(F.min("i").alias("i"))
    listed = twins.groupBy(*RESULT).agg(F.map_from_entries(F.collect_list(F.struct("j", "i"))).alias("twin"))
    classed = lookup_join(open_, listed, RESULT, "left")
    class_of = F.transform(places, lambda j: F.coalesce(F.try_element_at("twin", j), j))
    orders = F.udf(_orders, "array<array<int>>")
    tries = classed.select(*RESULT, "wanted", F.posexplode(orders(ranks, class_of)).alias("nth", "order"))
    # a result of a third of all rows is dealt to many tasks by the join
    every = tries.groupBy(*RESULT).agg(F.collect_list(F.struct("nth", "wanted", "order")).alias("tries"))
    placed = lookup_join(rows, every, RESULT).select(*RESULT, "cells", F.inline("tries"))
    answers = _in_order(placed, "nth", "wanted").groupBy(*RESULT).agg(
        F.max(F.col("result") == F.col("wanted")).alias("matches")
    )
    return settled.unionByName(answers)
