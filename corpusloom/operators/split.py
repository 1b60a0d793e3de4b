"""Stratified train / validation / test split."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.joins import lookup_join
from corpusloom.operators.ordering import (
    label_by_rank, label_by_thresholds, rank_thresholds, with_position, with_shuffle_key,
)
from corpusloom.sources.readers import union_named
from corpusloom.sources.staging import stage

# Split names in output order.
SPLITS = ("train", "validation", "test")
VAL_FRAC = 0.10
TEST_FRAC = 0.10
SMALLEST_STRATUM = 3


def share(size: Column, fraction: float) -> Column:
    """Rows a stratum gives to a held-out split: its share, rounded half to
    even, but at least one; none from a stratum that is too small."""
    rounded = F.rint(size * F.lit(float(fraction))).cast("long")
    return F.when(
        size >= SMALLEST_STRATUM, F.greatest(F.lit(1).cast("long"), rounded)
    ).otherwise(F.lit(0).cast("long"))


def _cuts(val_frac: float, test_frac: float) -> dict[str, Callable[[Column], Column]]:
    return {
        "test": lambda n: share(n, test_frac),
        "validation": lambda n: share(n, test_frac) + share(n, val_frac),
    }


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    seed: int = 42,
    val_frac: float = VAL_FRAC,
    test_frac: float = TEST_FRAC,
    row_id: str = "rec_id",
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Add ``split`` (and ``shuffle_key``): in each stratum's shuffle order
    first the test rows, then the validation rows, then the training rows."""
    keyed = with_shuffle_key(df, seed, row_id)
    keys = None if narrow is None else with_shuffle_key(narrow, seed, row_id)
    return label_by_rank(
        keyed, strata, _cuts(val_frac, test_frac), "train", row_id, "split", keys
    )


def split_thresholds(
    keyed: DataFrame,
    strata: Sequence[str],
    val_frac: float = VAL_FRAC,
    test_frac: float = TEST_FRAC,
    row_id: str = "rec_id",
) -> DataFrame:
    """Where each stratum is cut, to label several tables of the same rows."""
    return rank_thresholds(keyed, strata, _cuts(val_frac, test_frac), row_id)


def split_by_thresholds(
    keyed: DataFrame,
    strata: Sequence[str],
    thresholds: DataFrame,
    row_id: str = "rec_id",
    fits: bool | None = None,
) -> DataFrame:
    """Add ``split`` to rows that carry the same ``shuffle_key``; ``fits`` tells
    whether the thresholds may be broadcast, if that is known."""
    return label_by_thresholds(keyed, strata, thresholds, "train", row_id, "split", fits)


def split_counts(labelled: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows per stratum and held-out split: what ``split_appended`` needs of the
    rows that have labels. Staged, a row per stratum."""
    return stage(labelled.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("split") == name).alias(f"_{name}") for name in SPLITS[1:]],
    ))


def split_appended(
    df: DataFrame,
    counts: DataFrame,
    strata: Sequence[str],
    seed: int = 42,
    val_frac: float = VAL_FRAC,
    test_frac: float = TEST_FRAC,
    row_id: str = "rec_id",
) -> tuple[DataFrame, DataFrame]:
    """``split`` for rows appended to strata that were split before, and the new
    ``split_counts``.

    Labels given stay. A stratum that has grown owes each held-out split the
    difference to its share of the new size; the first new rows in shuffle order
    pay it, test before validation, as far as there are new rows. What is still
    owed then is paid by the next ones.
    """
    narrow = stage(with_shuffle_key(df.select(*strata, row_id), seed, row_id))
    grown = narrow.groupBy(*strata).agg(F.count(F.lit(1)).alias("_more"))
    joined = lookup_join(grown, counts, strata, "left", staged=True)
    had = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_n", *[f"_{name}" for name in SPLITS[1:]])}
    size = had["_n"] + F.col("_more")
    owed = lambda fraction, name: F.greatest(F.lit(0).cast("long"), share(size, fraction) - had[f"_{name}"])
    owing = stage(joined.select(
        *strata, owed(test_frac, "test").alias("_owed_test"), owed(val_frac, "validation").alias("_owed_val")
    ))
    groups = [*strata, "_owed_test", "_owed_val"]
    cuts = {"test": lambda n: F.col("_owed_test"), "validation": lambda n: F.col("_owed_test") + F.col("_owed_val")}
    keyed = lookup_join(with_shuffle_key(df, seed, row_id), owing, strata, staged=True)
    marked = stage(lookup_join(narrow, owing, strata, staged=True))
    labelled = stage(label_by_rank(keyed, groups, cuts, "train", row_id, "split", marked).drop("_owed_test", "_owed_val"))
    both = counts.unionByName(split_counts(labelled, strata)).groupBy(*strata).agg(
        *[F.sum(c).alias(c) for c in counts.columns if c not in strata]
    )
    return labelled, stage(both)


def split_rank(split: str = "split") -> Column:
    """Place of a split in the merged output."""
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col(split)).cast("int")


def merged_order(df: DataFrame, seed: int = 43, row_id: str = "rec_id") -> DataFrame:
    """Add ``position``: training, validation, test rows, each reshuffled."""
    rows = with_shuffle_key(df, seed, row_id).withColumn("_split_rank", split_rank())
    return with_position(rows, "_split_rank", row_id).drop("_split_rank", "shuffle_key")


def union_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """The merged set: bag union of the splits."""
    return union_named(splits, "split")
