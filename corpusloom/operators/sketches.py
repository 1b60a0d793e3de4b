"""Profiles of sources as sketches that merge.

A profile has one row per source: the exact number of rows and the longest
length, a HyperLogLog sketch of different values, and a histogram of lengths in
cells that grow by ``GROWTH``. An appended source is profiled alone and merged; no
old row is read again. Sums, maxima and sketch unions do not depend on order, so
neither does the merged profile. The sketch errs by about ``1.04 / sqrt(2 ** PRECISION)``
of the number of different values, a quantile by ``(GROWTH - 1) / (GROWTH + 1)`` of
its value: one percent.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

PRECISION = 14
GROWTH = 1.02


def cell(length: Column) -> Column:
    """Number of the cell of a length; -1 for zero."""
    at = F.ceil(F.log(F.greatest(length, F.lit(1))) / F.lit(math.log(GROWTH))).cast("int")
    return F.when(length <= 0, F.lit(-1)).otherwise(at)


def middle(at: Column) -> Column:
    """The length that stands for a cell."""
    value = F.pow(F.lit(GROWTH), at) * (2 / (GROWTH + 1))
    return F.when(at < 0, F.lit(0)).otherwise(F.round(value)).cast("long")


def profile(df: DataFrame, by: str, value: str, length: str) -> DataFrame:
    """``by, n, longest, different, cells``: the profile of each source. Null
    lengths count as rows only."""
    cells = df.where(F.col(length).isNotNull()).groupBy(by, cell(F.col(length)).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    # as many entries as there are cells, some thousand for any text
    lists = cells.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "c"))).alias("cells"))
    sums = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max(length).cast("long").alias("longest"),
        F.hll_sketch_agg(value, PRECISION).alias("different"),
    )
    return _with_cells(sums, lists, by)


def _with_cells(sums: DataFrame, lists: DataFrame, by: str) -> DataFrame:
    renamed = lists.withColumnRenamed(by, "_by")
    none = F.expr("map()").cast("map<int, bigint>")
    return sums.join(renamed, F.col(by).eqNullSafe(F.col("_by")), "left").select(
        by, "n", "longest", "different", F.coalesce("cells", none).alias("cells")
    )


def merge(*profiles: DataFrame, by: str) -> DataFrame:
    """One profile of several, in any order; sources that occur in several add up."""
    rows = reduce(DataFrame.unionByName, profiles)
    lists = rows.select(by, F.explode("cells").alias("cell", "c")).groupBy(by, "cell").agg(F.sum("c").alias("c")).groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "c"))).alias("cells")
    )
    sums = rows.groupBy(by).agg(
        F.sum("n").alias("n"), F.max("longest").alias("longest"),
        F.hll_union_agg("different").alias("different"),
    )
    return _with_cells(sums, lists, by)


def total(profiles: DataFrame, by: str, name: str = "merged") -> DataFrame:
    """The profile of all sources together, named ``name``."""
    return merge(profiles.withColumn(by, F.lit(name)), by=by)


def read(profiles: DataFrame, by: str, q: float = 0.9) -> DataFrame:
    """``by, n, different, p50, p90, longest`` as the sketches tell: the number of
    different values, and the lengths at the places ``floor((n - 1) / 2)`` and
    ``floor(q * n)`` of the sorted lengths."""
    entries = F.array_sort(F.map_entries("cells"))

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("cell"))
        found = F.aggregate(entries, start, lambda done, e: F.struct(
            (done["upto"] + e["value"]).alias("upto"),
            F.when(done["cell"].isNull() & (done["upto"] + e["value"] > place), e["key"]).otherwise(done["cell"]).alias("cell"),
        ))
        return middle(found["cell"])

    known = F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda a, b: a + b)
    return profiles.select(
        by, "n", F.hll_sketch_estimate("different").alias("different"),
        at(F.floor((known - 1) / 2)).alias("p50"), at(F.floor(known * F.lit(float(q)))).alias("p90"), "longest",
    )
