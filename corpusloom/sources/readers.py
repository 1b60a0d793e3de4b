"""Readers. Line order is part of the data: every reader returns ``ord``,
the dense 0-based position of the record in its input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.joins import lookup_join
from corpusloom.sources.arrays import read_array
from corpusloom.sources.staging import stage

CHAT = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
QUESTION = "db_id STRING, query STRING, question STRING"
CATALOG = (
    "db_id STRING, table_names_original ARRAY<STRING>, "
    "column_names_original ARRAY<ARRAY<STRING>>, foreign_keys ARRAY<ARRAY<INT>>"
)
PREDICTION = "sql STRING"
MANIFEST = "rec_id STRING, source STRING, bucket STRING, db STRING, position BIGINT, split STRING"


def natural_order(path: Column) -> Column:
    """Sort key of a path in which numbers count as numbers: part-99999 comes
    before part-100000."""
    runs = F.regexp_extract_all(path, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.rlike(x, F.lit("^[0-9]{1,20}$"))
    return F.array_join(F.transform(runs, lambda x: F.when(number(x), F.lpad(x, 20, "0")).otherwise(x)), "")


def _number(scan: DataFrame, *columns: Column) -> DataFrame:
    """``ord`` and the given columns of a file scan: files in path order,
    records in file order.

    The scan is written once, each record with its input split and the running
    id inside it; how files are cut into splits may differ from one scan to the
    next. Only the number of records in the splits before is missing, and one
    small row per split of that same table supplies it. No record is sorted.
    """
    frozen = stage(scan.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_run"),
    ))
    splits = frozen.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_run").alias("_first")
    )
    # a window without partitions, but over no more rows than the driver holds
    # to plan the scan: one per input split
    in_order = Window.orderBy(natural_order(F.col("_file")), "_file", "_start")
    before = F.sum("_n").over(in_order) - F.col("_n")
    offsets = stage(splits.select("_file", "_start", (before - F.col("_first")).alias("_shift")))
    lost = F.raise_error(F.concat(F.lit("no offset for a split of "), F.col("_file")))
    names = [c for c in frozen.columns if c not in ("_file", "_start", "_run")]
    # for the same reason the offsets are few enough to send to every task
    return lookup_join(frozen, offsets, ["_file", "_start"], "left", staged=True, fits=True).select(
        (F.col("_run") + F.coalesce("_shift", lost)).alias("ord"), *names
    )


def _at_line(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message} at line "), F.col("ord").cast("string")))


def _lines(spark: SparkSession, path: str | list[str], schema: str, needed: Sequence[str]) -> DataFrame:
    """JSON Lines with ``ord``, parsed once. A line that is not a JSON object,
    or has none of a ``needed`` key, fails the job."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")
    text = spark.read.text(path).select("value", "_metadata")
    fields = text.select(parsed, "_metadata")
    rows = _number(fields, F.col("_r").isNotNull().alias("_ok"), F.col("_r.*"))
    names = [c for c in rows.columns if c not in ("ord", "_ok")]
    return rows.select(
        F.when(F.col("_ok"), F.col("ord")).otherwise(_at_line("no JSON object")).alias("ord"),
        *[F.coalesce(c, _at_line(f"no {c}")).alias(c) if c in needed else F.col(c) for c in names],
    )


def read_chat(
    spark: SparkSession,
    path: str | list[str],
    stored_ord: bool | str = False,
    with_id: bool = False,
) -> DataFrame:
    """Chat records: ``ord, messages``, and ``rec_id`` with ``with_id``.

    With ``stored_ord`` the records bring their own order, in ``ord`` or the
    field named, as those written by the clean and the merge job do: the input
    need not be numbered, and two records with the same value fail the job.
    """
    identity = ["rec_id"] if with_id else []
    chat = ", ".join([*(f"{c} STRING" for c in identity), CHAT])
    if not stored_ord:
        return _lines(spark, path, chat, ["messages", *identity])
    name = "ord" if stored_ord is True else stored_ord
    reader = spark.read.schema(f"{name} BIGINT, {chat}").option("mode", "FAILFAST")
    missing = F.raise_error(F.lit("a record has no stored ord"))
    records = stage(reader.json(path).select(
        F.coalesce(name, missing).alias("ord"), *identity, "messages"
    ))
    twice = records.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ord").first()
    if twice:
        raise ValueError(f"stored ord {twice['ord']} is not unique")
    return records


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Predicted SQL, one per gold record: ``ord, sql``."""
    return _lines(spark, path, PREDICTION, ["sql"])


def tag_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    """Add the name of the input as a column."""
    return df.withColumn(column, F.lit(source))


def union_named(named: Mapping[str, DataFrame], column: str) -> DataFrame:
    """Bag union of named inputs, tagged with their names."""
    return reduce(
        DataFrame.unionByName, [tag_source(df, name, column) for name, df in named.items()]
    )


def read_splits(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Several splits together: ``ord, messages, split``."""
    return union_named({name: read_chat(spark, path) for name, path in paths.items()}, "split")


def _documents(
    spark: SparkSession, path: str | list[str], schema: str, array: bool, needed: Sequence[str]
) -> DataFrame:
    if not array:
        return _lines(spark, path, schema, needed)
    rows = read_array(spark, path, schema, natural_order(F.col("file")))
    return rows.select(
        "ord",
        *[F.coalesce(c, _at_line(f"no {c}")).alias(c) if c in needed else F.col(c) for c in rows.columns if c != "ord"],
    )


def read_questions(spark: SparkSession, path: str | list[str], array: bool = False) -> DataFrame:
    """Raw questions from JSON Lines; with ``array`` each file is one JSON array,
    which many tasks read."""
    return _documents(spark, path, QUESTION, array, ["db_id", "query", "question"])


def read_catalog(spark: SparkSession, path: str | list[str], array: bool = False) -> DataFrame:
    """Schema catalog, one row per ``db_id``; the last duplicate wins."""
    return last_per_db(_documents(spark, path, CATALOG, array, ["db_id"]))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The manifest that the merge job writes."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def last_per_db(catalog: DataFrame) -> DataFrame:
    """Keep the entry with the highest ``ord`` of each ``db_id``."""
    newest_first = Window.partitionBy("db_id").orderBy(F.desc("ord"))
    return (
        catalog.withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") == 1)
        .drop("_rn", "ord")
    )

