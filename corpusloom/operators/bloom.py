"""A Bloom filter as a table of one row: an array of bit words.

Rows are tested by array and bit functions before anything is shuffled; whoever
passes is compared exactly afterwards, so false positives cost time only. The
array is bounded by ``MOST`` bits (16 MB), whatever the number of keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

PROBES = 3
BITS_PER_KEY = 16
MOST = 1 << 27


def bits(n: int) -> int:
    """Bits of the filter of ``n`` keys: a power of two."""
    return min(MOST, max(64, 1 << (max(n, 1) * BITS_PER_KEY - 1).bit_length()))


def false_positives(n: int) -> float:
    """Expected share of other keys that pass the filter of ``n`` keys."""
    return (1 - math.exp(-PROBES * n / bits(n))) ** PROBES


def _probes(a: Column, b: Column, size: int) -> list[Column]:
    """Bit numbers of a key given as 64 and 32 bits of hash, from bits of their own."""
    fields = [a, F.shiftrightunsigned(a, 32), b.cast("bigint")]
    return [f.bitwiseAND(F.lit(size - 1).cast("bigint")) for f in fields]


def build(keys: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """``words``: the filter of the keys, in one row."""
    numbers = keys.select(F.explode(F.array(*_probes(F.col(a), F.col(b), size))).alias("bit")).distinct()
    bit = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    words = numbers.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(bit).alias("set"))
    every = keys.sparkSession.range(size // 64).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))
    # at most MOST / 64 words
    return filled.agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("w")).select(F.col("w.set").alias("words"))


def may_hold(words: Column, a: Column, b: Column, size: int) -> Column:
    """Whether the key may be in the filter; never false for one that is."""
    passed = F.lit(True)
    for bit in _probes(a, b, size):
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        passed = passed & (F.bit_get(word, bit.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1)
    return passed
