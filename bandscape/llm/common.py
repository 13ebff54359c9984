"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.graph import components as components
from ..functions.joins import attach
from ..functions.runtime import materialise

SENT = 2_000_000            # row numbers sent to every executor at once
PORTION = 2 << 20           # bytes of text in hand at once
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}{n}"
    return name


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` written once with a row number, so that equal rows stay apart."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()))


def portions(batch: pa.RecordBatch, at: int, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes in column ``at``; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow or mapInPandas that gives freed memory back when a task ends.

    Spark keeps Python workers for later tasks; without this an idle one goes on
    holding the most that any of its tasks ever needed.
    """
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # where the C library has it
                trim(0)

    return run


def without_rows(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number is in ``gone``, which is broadcast up to ``SENT`` numbers."""
    gone = materialise(gone.select(row).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= SENT else gone, row, "left_anti")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone: ``lower`` would also change other alphabets."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str, total: str) -> DataFrame:
    """``df`` written in order, with each row's place from 0 within ``keys`` and the rows of its key.

    One shuffle by ranges of keys and order, so the rows of a hot key span many
    parts; a place is the row's place in its part plus the rows of earlier parts.
    ``keys`` must not be null and ``order`` must tell rows apart where a tie could
    be large.  ``df`` is read twice, so it should be a written table.
    """
    placed = (df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn("_at", F.monotonically_increasing_id()))       # part and place in it
    placed = materialise(placed).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)                                    # a row for each part
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    starts = sizes.select(*keys, "_part", (before - F.col("_first")).alias("_start"), F.sum("_n").over(whole).alias(total))
    return (attach(placed, starts, [*keys, "_part"]).withColumn(out, F.col("_at") + F.col("_start"))
            .drop("_at", "_part", "_start"))
