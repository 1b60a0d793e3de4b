"""Writers: JSON Lines folders, and one text file of many parts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_jsonl(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    compression: str | None = None,
) -> None:
    """Write one JSON object per line, with all columns or with ``columns``.

    With ``order_by`` the rows are range partitioned and sorted, so the files in
    the order of their numbers hold the rows in that order. Without, the rows
    stay as they lie. Null fields are left out. A compressed file is read by one
    task, so ``compression`` is for files of bounded size.
    """
    if order_by:
        df = df.repartitionByRange(*order_by)
        # sorted by partition column first, as the partitioned write wants it:
        # otherwise it would sort again and lose the order
        df = df.sortWithinPartitions(*partition_by, *order_by)
    if columns is not None:
        df = df.select(*partition_by, *columns)
    df.write.partitionBy(*partition_by).json(path, compression=compression)


def write_summary(df: DataFrame, path: str) -> None:
    """Write a small result (statistics, metrics, a report) as a single file."""
    df.coalesce(1).write.json(path)


def write_lines(staged: DataFrame, path: str) -> None:
    """Write a staged table of one column ``value`` as a single text file, its
    parts one after the other.

    A file has one writer, but that one neither sorts nor holds the rows: order
    them by many tasks before they are staged.
    """
    parts = staged.sparkSession.createDataFrame(
        pa.table({"parts": pa.array([sorted(staged.inputFiles())], pa.list_(pa.string()))})
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for part in batch["parts"][0].as_py():
                store, place = fs.FileSystem.from_uri(part)
                with store.open_input_file(place) as file:
                    yield from pq.ParquetFile(file).iter_batches(8192, columns=["value"])

    parts.coalesce(1).mapInArrow(run, "value string").write.text(path)
