"""Audits of repetition: inside a table, and between two tables.

Keys are compared by a digest of their whole text, so what is shuffled is
narrow however long the texts are; nothing is capped or sampled. Equal texts are
counted before the shuffle, so a text that holds a third of all rows is one row
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators import bloom
from corpusloom.operators.joins import fits_broadcast, lookup_join
from corpusloom.sources.staging import stage

# Words in a row that make a passage, and the fewest a shorter whole text needs to count as one.
PASSAGE = 13
LEAST = 8
KEY = ["n", "a", "b"]


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts; null and empty differ, and so do ways to
    cut the same text into columns."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def duplicates(df: DataFrame, keys: Sequence[Column], row_id: str) -> DataFrame:
    """One row per key that occurs more than once: ``first_id, n``."""
    counted = df.select(digest(*keys).alias("d"), row_id).groupBy("d").agg(
        F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    return counted.where(F.col("n") > 1).select("first_id", "n")


def leaks(df: DataFrame, other: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Ids of the rows whose key occurs in ``other`` too."""
    mine = df.select(row_id, digest(*[df[k] for k in keys]).alias("d"))
    theirs = other.select(digest(*[other[k] for k in keys]).alias("d")).distinct()
    return lookup_join(mine, theirs, ["d"], "left_semi").select(row_id)


def _word_hashes(text: Column) -> Column:
    """Lower-case runs of letters and digits, hashed in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def _windows(words: Column, n: Column, name: Column) -> Column:
    """Keys of all runs of ``n`` words, as ``name`` and 96 bits of hash."""

    def key(i: Column) -> Column:
        run = F.slice(words, i, n)
        return F.struct(name.alias("n"), F.xxhash64(run).alias("a"), F.hash(run).alias("b"))

    none = F.array().cast("array<struct<n: int, a: bigint, b: int>>")
    return F.when((n > 0) & (F.size(words) >= n), F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), key)).otherwise(none)


def passage_leaks(df: DataFrame, other: DataFrame, text: str, row_id: str) -> DataFrame:
    """Ids of the rows whose text shares a passage with a text of ``other``:
    ``PASSAGE`` words in a row, whatever their case, marks and line breaks. A
    text of ``other`` with fewer words must occur whole; below ``LEAST`` words
    it must be all of the row's text. Once per id.

    Passages of ``other`` that do not fit a broadcast become a Bloom filter, which
    the rows' windows must pass before they are shuffled."""
    theirs = other.select(_word_hashes(other[text]).alias("words")).withColumn("size", F.size("words"))
    length = F.least("size", F.lit(PASSAGE))
    name = F.when(F.col("size") < LEAST, 0).otherwise(length)
    # at most one value for each of LEAST to PASSAGE
    lengths = sorted(r["n"] for r in theirs.where(F.col("size") >= LEAST).select(length.alias("n")).distinct().collect())
    wanted = theirs.select(F.inline(_windows(F.col("words"), length, name))).distinct()

    def keys(words: Column) -> Column:
        whole = F.when(F.size(words) < LEAST, F.size(words)).otherwise(0)
        return F.concat(_windows(words, whole, F.lit(0)), *[_windows(words, F.lit(n), F.lit(n)) for n in lengths])

    # bound once per row by the outer lambda
    own = F.transform(F.array(_word_hashes(df[text])), keys)[0]
    windows = df.select(row_id, F.inline(own))
    wanted = stage(wanted)
    fits = fits_broadcast(wanted)
    if not fits:
        windows = stage(filtered(windows, wanted))
    return lookup_join(windows, wanted, KEY, "left_semi", staged=True, fits=fits).select(row_id).distinct()


def filtered(windows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows that may be among the wanted ones."""
    size = bloom.bits(wanted.count())
    words = bloom.build(wanted, "a", "b", size).scalar()
    return windows.where(bloom.may_hold(words, F.col("a"), F.col("b"), size))


def split_leaks(rows: DataFrame, keys: Sequence[str], row_id: str = "rec_id") -> DataFrame:
    """Rows whose key occurs in more than one split: ``row_id, split, splits``."""
    marked = rows.select(row_id, "split", digest(*[rows[k] for k in keys]).alias("d"))
    spread = marked.groupBy("d").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    shared = spread.where(F.size("splits") > 1)
    return lookup_join(marked, shared, ["d"]).select(row_id, "split", F.concat_ws(",", "splits").alias("splits"))
