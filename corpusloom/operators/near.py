"""Near leaks between splits: rows whose word set is much like one of another split.

An exact set-similarity join by prefix filtering. Sets are compared once each,
however many rows have them. Words are ordered from rare to frequent over all
sets; two sets of Jaccard similarity ``PERCENT`` share a word among the first
``size - ceil(PERCENT * size) + 1`` of each, so only those become keys: a word
that stands in most sets is a key only of sets that have nothing rarer. If keys
are still crowded, pairs of words are keys instead, of prefixes longer by one. The
choice follows the measured number of pairs, changes no result, and what a key
keeps above ``CROWD`` sets is dealt to cells of bounded size. Every pair that meets
is verified on the whole sets. Sets without words are like none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.audits import digest
from corpusloom.operators.joins import lookup_join
from corpusloom.sources.staging import stage

PERCENT = 80
# Pairs per set above which pairs of words are tried, sets of a key that meet in one cell.
PAIRS = 64
CROWD = 1000
WORD = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"


def word_set(*texts: Column) -> Column:
    """Different words and marks of the texts in lower case, sorted."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))


def _ranked(sets: DataFrame) -> DataFrame:
    """``d, splits, words, size``, the words of each set from rare to frequent."""
    each = sets.select("d", "splits", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # one list per set, as long as the set
    ordered = lookup_join(each, counts, ["word"]).groupBy("d", "splits").agg(
        F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked")
    )
    return stage(ordered.select("d", "splits", F.col("ranked.word").alias("words"), F.size("ranked").alias("size")))


def _keys(ranked: DataFrame, percent: int, together: int) -> DataFrame:
    """The rows once per key: a word of the prefix, or two."""
    needed = F.ceil(F.col("size") * percent / 100).cast("int")
    prefix = F.slice("words", F.lit(1), F.col("size") - needed + together)
    if together == 1:
        keys = prefix
    else:
        pairs = lambda a, i: F.transform(
            F.slice(prefix, i + 2, F.size(prefix)), lambda b: F.concat_ws(" ", a, b)
        )
        # sets so small that one common word may do
        alone = F.when(needed <= 1, F.col("words")).otherwise(F.array().cast("array<string>"))
        keys = F.concat(F.flatten(F.transform(prefix, pairs)), alone)
    return ranked.withColumn("key", F.explode(keys))


def _crowding(keys: DataFrame) -> tuple[DataFrame, float]:
    """How many sets each key has, and the pairs that would meet."""
    counts = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    return counts, float(counts.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0)


def near_pairs(ranked: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``d, near``: each set with the splits of a set like it, both ways, for pairs
    that do not have one and the same split."""
    sets = ranked.count()
    keys = _keys(ranked, percent, 1)
    counts, pairs = _crowding(keys)
    if pairs > PAIRS * sets:
        paired = _keys(ranked, percent, 2)
        counts_2, pairs_2 = _crowding(paired)
        if pairs_2 < pairs:
            keys, counts = paired, counts_2
    crowded = stage(counts.where(F.col("n") > CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")))
    dealt = lookup_join(keys, crowded, ["key"], "left", staged=True)
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("d"), blocks).cast("int"))
    # two blocks of a crowded key meet in one cell
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "d", "splits", "words", "size", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
    )
    a, b = met.alias("a"), met.alias("b")
    cell = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    fresh = (F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own"))
    one_split = (F.size("a.splits") == 1) & (F.col("a.splits") == F.col("b.splits"))
    lengths = F.least("a.size", "b.size") * 100 >= F.greatest("a.size", "b.size") * percent
    pairs = a.join(b, cell & (F.col("a.d") < F.col("b.d")) & fresh & ~one_split & lengths)
    shared = F.size(F.array_intersect("a.words", "b.words"))
    like = pairs.where(shared * 100 >= percent * (F.col("a.size") + F.col("b.size") - shared))
    both = F.array(
        F.struct(F.col("a.d").alias("d"), F.col("b.splits").alias("near")),
        F.struct(F.col("b.d").alias("d"), F.col("a.splits").alias("near")),
    )
    return like.select(F.inline(both))


def split_near_leaks(rows: DataFrame, words: Column, row_id: str = "rec_id", percent: int = PERCENT) -> DataFrame:
    """``row_id, split, splits`` of the rows whose word set is like that of a row
    of another split; ``splits`` are those others."""
    marked = rows.select(row_id, "split", words.alias("words")).where(F.size("words") > 0)
    marked = marked.withColumn("d", digest(F.array_join("words", " ")))
    # the number of splits bounds the list
    sets = stage(marked.groupBy("d").agg(
        F.first("words").alias("words"), F.sort_array(F.collect_set("split")).alias("splits")
    ))
    near = near_pairs(_ranked(sets), percent).select("d", F.explode("near").alias("split"))
    own = sets.select("d", F.explode("splits").alias("split"))
    reach = near.unionByName(own).groupBy("d").agg(F.collect_set("split").alias("all"))
    several = reach.where(F.size("all") > 1)
    joined = lookup_join(marked.select(row_id, "split", "d"), several, ["d"])
    others = F.array_except("all", F.array("split"))
    return joined.where(F.size(others) > 0).select(
        row_id, "split", F.array_join(F.sort_array(others), ",").alias("splits")
    )
