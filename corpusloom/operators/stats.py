"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.features import FEATURES
from corpusloom.functions.text import CHARS_PER_TOKEN, est_tokens
from corpusloom.operators.ordering import head


def _count() -> Column:
    return F.count(F.lit(1))


def split_stats(df: DataFrame) -> DataFrame:
    """Counts in long form: ``dimension, split, source, bucket, n``.

    The rows are counted once per (split, source, bucket); the grouping sets
    expand only those few counts.
    """
    base = df.groupBy("split", "source", "bucket").agg(_count().alias("n"))
    cols = [F.col(c) for c in ("split", "source", "bucket")]
    split, source, bucket = cols
    sets = [[], [source], [bucket], [split], [split, bucket]]
    # grouping id: one bit per column, set where the column is summed away
    names = {7: "merged", 5: "source", 6: "bucket", 3: "split", 2: "split_bucket"}
    gid = F.col("_gid")
    dimension = F
    for number, name in names.items():
        dimension = dimension.when(gid == number, name)
    return (
        base.groupingSets(sets, *cols)
        .agg(F.grouping_id().alias("_gid"), F.sum("n").alias("n"))
        .select(dimension.alias("dimension"), "split", "source", "bucket", "n")
    )


def split_summary(stats: DataFrame) -> DataFrame:
    """``split_stats`` as one row of maps, the form in which it is published.

    The maps have one entry per split, named source or bucket.
    """

    def counts(dimension: str, key: str, split: str | None = None) -> Column:
        rows = F.col("dimension") == dimension
        if split is not None:
            rows &= F.col("split") == split
        return F.map_from_entries(F.collect_list(F.when(rows, F.struct(key, "n"))))

    merged = F.create_map(
        F.lit("merged"), F.coalesce(F.max(F.when(F.col("dimension") == "merged", F.col("n"))),
                                    F.lit(0)).cast("long")
    )
    return stats.agg(
        F.map_concat(merged, counts("split", "split")).alias("counts"),
        counts("source", "source").alias("by_source"),
        counts("bucket", "bucket").alias("by_bucket"),
        counts("split_bucket", "bucket", "train").alias("train_by_bucket"),
        counts("split_bucket", "bucket", "validation").alias("val_by_bucket"),
        counts("split_bucket", "bucket", "test").alias("test_by_bucket"),
    )


def distinct_dbs(df: DataFrame, db: str = "db_id", by: Sequence[str] = ()) -> DataFrame:
    """Exact number of distinct databases."""
    return df.groupBy(*by).agg(F.count_distinct(db).alias("distinct_dbs"))


def feature_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and rows per feature; needs ``with_features``."""
    return df.groupBy(*by).agg(
        _count().alias("n"),
        *[F.count_if(f"has_{name}").alias(name) for name in FEATURES],
    )


def feature_rollup(df: DataFrame, by: str = "source", total: str = "merged") -> DataFrame:
    """Feature totals per source and for all sources together."""
    parts = feature_totals(df, [by])
    label = F.when(F.grouping(by) == 1, total).otherwise(F.col(by))
    counts = [F.sum(name).alias(name) for name in ("n", *FEATURES)]
    return parts.rollup(by).agg(label.alias("_label"), *counts).drop(by).withColumnRenamed(
        "_label", by
    )


def length_profile(
    df: DataFrame, length: str, by: Sequence[str] = (), q: float = 0.9
) -> DataFrame:
    """Median (truncated), element ``int(q * n)`` of the sorted lengths, maximum
    and the token estimate of the maximum.

    The rows are reduced to one count per distinct length; the running count
    that finds the positions sees no more rows than the longest text has
    characters, however many texts there are.
    """
    hist = df.groupBy(*by, F.col(length).alias("_len")).agg(_count().alias("_c"))
    group = Window.partitionBy(*by)
    n = F.sum("_c").over(group)
    running = hist.withColumns({"_n": n, "_upto": F.sum("_c").over(group.orderBy("_len"))})

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("_len")))

    size = F.col("_n")
    below, above = at(F.floor((size - 1) / 2)), at(F.floor(size / 2))
    top = F.max("_len")
    return running.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.floor((below + above) / 2).cast("long").alias("p50"),
        at(F.floor(size * F.lit(float(q)))).cast("long").alias("p90"),
        top.cast("long").alias("longest"),
        F.floor(top / F.lit(CHARS_PER_TOKEN)).alias("est_max_tokens"),
    )


def length_preview(
    df: DataFrame, text: str, n: int = 200, i: int = 100, order_by: str = "ord"
) -> DataFrame:
    """Token estimates of the first ``n`` rows: the i-th smallest and the largest."""
    tokens = head(df, n, order_by).select(est_tokens(F.col(text)).alias("_tokens"))
    lengths = tokens.agg(F.sort_array(F.collect_list("_tokens")).alias("_sorted"))
    return lengths.select(
        F.get("_sorted", F.lit(i)).alias("p50"), F.array_max("_sorted").alias("longest")
    )


def cleaning_report(df: DataFrame, fixed: str = "fixed", parses: str = "parses") -> DataFrame:
    """Records, targets that lost a semicolon, targets that do not parse."""
    return df.agg(
        _count().alias("records"),
        F.count_if(fixed).alias("fixed_semicolons"),
        F.count_if(~F.col(parses)).alias("unparseable"),
    )
