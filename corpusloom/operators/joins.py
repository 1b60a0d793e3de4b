"""Joins, written so that one hot key cannot fill one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.sources.staging import stage

# A lookup table is broadcast only when its measured size is below both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
# A key is hot when it holds more than this share of the rows, so there are
# fewer than HOT_SHARE hot keys however large the data is. The rows of a hot key
# are dealt to SALTS tasks.
HOT_SHARE = 64
SALTS = 64


def measured(table: DataFrame, *more: Column) -> tuple:
    """Whether a staged table may be broadcast, by its rows and the bytes of its
    fields as JSON text; with the values of further aggregates."""
    bytes_ = F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))
    n, size, *values = table.agg(F.count(F.lit(1)), bytes_, *more).first()
    return (n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES, *values)


def fits_broadcast(table: DataFrame) -> bool:
    """The same for a table of any size: the rows, which cost no scan, are
    counted first."""
    return table.count() <= BROADCAST_ROWS and measured(table)[0]


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys]
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return left.join(renamed, _match(left, renamed, keys), how).drop(
        *[f"_key_{k}" for k in keys]
    )


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    staged: bool = False,
    fits: bool | None = None,
) -> DataFrame:
    """Many-to-one join to a lookup table; null keys match null keys.

    The table is staged and measured. If it is small it is broadcast and ``df``
    is not shuffled at all. If not, the keys of ``df`` are counted, the rows of
    hot keys get a salt, the few table rows they need are repeated once per
    salt, and one shuffle join follows, in which no key is hot any more. Pass
    ``staged`` when the table is staged already, and ``fits`` when its size is
    known.
    """
    table = table if staged else stage(table)
    if fits_broadcast(table) if fits is None else fits:
        return _join(df, F.broadcast(table), keys, how)

    counts = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # fewer than HOT_SHARE rows of keys
    hot = F.broadcast(
        counts.where(F.col("_n") > total / HOT_SHARE).select(*keys, F.lit(True).alias("_hot"))
    )
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = _join(df, hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), dealt).otherwise(F.lit(0))
    ).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = _join(table, hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return _join(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def attach_schema(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``schema_text`` by ``db_id``; a database without a schema fails the job."""
    joined = lookup_join(df, catalog.select("db_id", "schema_text"), ["db_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no schema for database "), F.col("db_id")))
    return joined.withColumn("schema_text", F.coalesce("schema_text", missing))


def attach_evidence(df: DataFrame, evidence: DataFrame, key: str = "question") -> DataFrame:
    """Add ``evidence`` by question key; rows without any keep null. A key that
    the evidence lists twice fails the job."""
    listed = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.first("evidence").alias("evidence"))
    twice = F.raise_error(F.concat(F.lit("evidence is listed twice for "), F.col(key).cast("string")))
    once = listed.select(key, F.when(F.col("_times") == 1, F.col("evidence")).otherwise(twice).alias("evidence"))
    return lookup_join(df, once, [key], "left")


def with_group_size(df: DataFrame, keys: Sequence[str], out: str = "group_size") -> DataFrame:
    """Add to each row the number of rows that share its ``keys``."""
    return lookup_join(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)


def remaining(pool: DataFrame, picked: DataFrame, key: str = "rec_id") -> DataFrame:
    """Rows of the pool that are not picked yet."""
    return pool.join(picked.select(key), key, "left_anti")


def align(gold: DataFrame, pred: DataFrame, key: str = "ord") -> DataFrame:
    """Pair gold and predicted rows by position, keeping rows without a partner.

    ``in_gold`` and ``in_pred`` tell the sides, so a length mismatch is found
    in the same pass that scores the pairs.
    """
    return gold.withColumn("in_gold", F.lit(True)).join(
        pred.withColumn("in_pred", F.lit(True)), key, "full_outer"
    ).withColumns({
        "in_gold": F.coalesce("in_gold", F.lit(False)),
        "in_pred": F.coalesce("in_pred", F.lit(False)),
    })
