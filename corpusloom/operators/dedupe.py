"""First-wins deduplication, at once or source by source."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.audits import digest
from corpusloom.sources.staging import stage

# Buckets of a store of kept keys: each is read by one task.
BUCKETS = 64


def dedupe_first(df: DataFrame, keys: Mapping[str, Column], order_by: str) -> DataFrame:
    """Keep the first row in input order for each combination of ``keys``.

    The rank filter becomes a group limit that runs before the shuffle, so each
    task sends on one row per key and a key with very many copies stays cheap.
    Long texts belong in ``keys`` as a digest (``text_key``), not as they are.
    """
    named = {f"_key_{name}": key for name, key in keys.items()}
    first = Window.partitionBy(*named).orderBy(order_by)
    return (
        df.withColumns(named)
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") == 1)
        .drop("_rn", *named)
    )


def text_key(text: Column) -> Column:
    """Fixed-width key of a text of any length: all of it counts."""
    return F.sha2(text, 256)


def dedupe_paraphrases(df: DataFrame, order_by: str = "rec_id") -> DataFrame:
    """Keep one question per database and query, ignoring case."""
    keys = {"db": F.col("db_id"), "sql": text_key(F.upper("sql"))}
    return dedupe_first(df, keys, order_by)


class KeptKeys:
    """Digests of the keys that were kept so far, in a bucketed table.

    The table is stored by buckets of the digest and sorted in them, below a
    folder, so that new rows join it without a shuffle of what was kept. It
    outlives the session: another one opens it by its folder. One writer at a
    time. A store has a fixed number of buckets, of some million keys each.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> None:
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) or "'" in folder:
            raise ValueError(f"no name or folder for a table: {name}, {folder}")
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (d STRING) USING parquet "
            f"CLUSTERED BY (d) SORTED BY (d) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def fresh(self, df: DataFrame, keys: Mapping[str, Column], order_by: str) -> DataFrame:
        """The first row of each key of ``df`` that was not kept before, with its
        digest ``_d``. The new side alone is shuffled, after first-wins."""
        named = df.withColumn("_d", digest(*keys.values()))
        first = dedupe_first(named, {"d": F.col("_d")}, order_by)
        kept = self.spark.table(self.name).hint("merge")
        return first.join(kept, F.col("_d") == F.col("d"), "left_anti")

    def append(self, df: DataFrame, keys: Mapping[str, Column], order_by: str) -> DataFrame:
        """``fresh`` rows, staged, whose keys are kept from now on."""
        rows = stage(self.fresh(df, keys, order_by))
        rows.select(F.col("_d").alias("d")).repartition(self.buckets, "d").write.insertInto(self.name)
        return rows.drop("_d")
