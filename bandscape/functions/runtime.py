"""Intermediate tables that are read more than once or end a long lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Folder shared by all executors, named by the cluster.
CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_folder: str | None = None
_written: list[str] = []
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _shared_folder(spark: SparkSession) -> str:
    global _local_folder
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if _local_folder is None:                   # single machine only
        _local_folder = tempfile.mkdtemp(prefix="bandscape-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that :func:`release` deletes."""
    path = f"{_shared_folder(spark)}/bandscape/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    The table is computed once, read with column pruning, has a known size, and
    outlives executors: a lost one costs a re-read and not a replay of all
    earlier steps of the loop.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def is_written(df: DataFrame) -> bool:
    """Is ``df`` itself a table written by :func:`materialise`?"""
    return df in _tables


def discard(table: DataFrame) -> None:
    """Delete a table written by :func:`materialise` that nothing reads any more."""
    path = _tables.pop(table)
    _written.remove(path)
    _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table written by :func:`materialise`, once results are stored."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
