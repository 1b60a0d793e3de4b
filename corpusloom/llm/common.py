"""Column helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# the six ASCII blanks that separate words
BLANKS = " \t\n\u000b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row although a lambda
    inside ``body`` may use it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between ASCII blanks; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(F.length(trimmed) == 0, none).otherwise(F.split(trimmed, BLANK_RUN))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct ``row`` next to the given columns.

    Whatever the input calls its columns, they cannot clash with those an
    operator adds; ``select("row.*")`` restores them.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, *[column.alias(name) for name, column in columns.items()])


def matching(key: Column, digest: Column) -> list[Column]:
    """Columns ``k, k_null, d`` that are equal where key and digest are, null
    keys included. Plain equality lets a window after a join use its shuffle."""
    plain = F.coalesce(key.cast("string"), F.lit(""))
    return [plain.alias("k"), key.isNull().alias("k_null"), digest.alias("d")]


MATCH = ["k", "k_null", "d"]


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the decimal id leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def unit_hash(*columns: Column | str, salt: int = 0) -> Column:
    """A number in (0, 1) that depends on the given columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *columns), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that what is made of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
