"""Longest-processing-time scheduling of documents to shards of near-equal bytes.

Rows with equal texts stay together.  Groups, largest first, go to the shard with
the least bytes, through a heap.  The heap sees runs of equally large groups, not
groups: a run is placed by its count, and its groups are told apart only where
they are, by their rank in the run.  Groups above a 65,536th of all bytes and
sizes up to ``EXACT`` bytes form runs of one exact size; other sizes are rounded
to within 0.1 %.  So the driver holds at most about 170,000 runs, plus one for
each partition, whatever the number of documents.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise

EXACT = 1 << 16             # bytes up to which a run has one exact size
HEAVY = 4096                # groups above 1/HEAVY of a shard's share are placed by exact size
ROUND = 1024                # other sizes are rounded to one in ROUND parts


def place_run(heap: list[tuple[int, int]], size: int, n: int) -> list[int]:
    """Counts per shard for ``n`` groups of ``size`` bytes; ``heap`` holds (bytes, shard)."""
    counts = [0] * len(heap)
    if n > 4 * len(heap):                       # what the greedy rule surely gives each shard
        loads = sorted(heap)
        total, width = sum(load for load, _ in loads) + n * size, len(loads)
        while width > 1 and loads[width - 1][0] * width > total:
            width -= 1
            total -= loads[width][0]
        for load, shard in loads[:width]:
            counts[shard] = max(0, (total // width - load) // size - 1)
        n -= sum(counts)
        heap[:] = [(load + counts[shard] * size, shard) for load, shard in heap]
        heapq.heapify(heap)
    for _ in range(n):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        counts[shard] += 1
    return counts


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``.

    ``size`` is the UTF-8 length plus one; a null text counts as empty and shares
    the group of empty texts.  ``slot`` numbers the rows of a shard from 0.
    Repeated rows and null keys keep a slot each; ties in size are broken by the
    text's digest.  A group larger than a shard's share fills a shard alone.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"),
                                   F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("group")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2("bytes"))) / ROUND, F.lit(1.0))
    heavy = F.col("bytes") > total // (shards * HEAVY)
    run = F.when(heavy | (F.col("bytes") <= EXACT), F.col("bytes")).otherwise((F.floor(F.col("bytes") / step) * step).cast("long"))
    sorted_groups = materialise(groups.withColumn("run", run).repartitionByRange(F.desc("run"), "group")
                                .withColumn("part", F.spark_partition_id()))
    runs = sorted_groups.groupBy("run", "part").agg(F.count("*").alias("n"), F.avg("bytes").cast("long").alias("mean"))
    plan = _plan(runs.toPandas(), shards)       # bounded, see above
    plan = docs.sparkSession.createDataFrame(plan)
    rank = F.row_number().over(Window.partitionBy("run", "part").orderBy("group"))      # within one range part
    placed = (sorted_groups.withColumn("rank", rank).join(plan, ["run", "part"])
              .select("group", F.expr("cast(size(filter(upto, u -> u < rank)) as int)").alias("shard")))
    return _slots(rows.join(placed, "group").drop("group")).withColumnRenamed("key", key)


def _plan(runs: pd.DataFrame, shards: int) -> pa.Table:
    """For each run the last rank that each shard takes."""
    runs = runs.sort_values(["run", "part"], ascending=[False, True])
    heap = [(0, s) for s in range(shards)]
    upto = [list(accumulate(place_run(heap, int(size), int(n)))) for size, n in zip(runs["mean"], runs["n"])]
    return pa.table({"run": pa.array(runs["run"], pa.int64()), "part": pa.array(runs["part"], pa.int32()),
                     "upto": pa.array(upto, pa.list_(pa.int64()))})


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard: place in a range part plus the sizes of earlier parts."""
    parts = materialise(rows.repartitionByRange("shard", "key", "text_crc32").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")     # a row per part
    starts = F.broadcast(sizes.select("shard", "part", before.alias("start")))             # shards + parts rows
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "text_crc32")) - 1
    return (parts.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + inside).cast("long"))
            .select("key", "size", "text_crc32", "shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs``, unique by ``key``, as one folder a shard, files in slot order."""
    placed = assign(docs, shards, key, text).select(key, "shard", "slot")
    (docs.join(placed, key).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
