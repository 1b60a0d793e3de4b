"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A staged table cuts lineage like a checkpoint, survives the loss of executors,
and has an exact size, which ``lookup_join`` checks before it broadcasts.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # one process, so its own folder is shared by all its tasks
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/corpusloom/{spark.conf.get('spark.app.id')}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete the staged tables of this application, once its results are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
