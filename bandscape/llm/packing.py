"""Training sequences of power-of-two lengths that never cross documents.

A document of n tokens is cut into pieces whose lengths are powers of two: as
many of the longest length as it holds, then those of the binary digits of the
rest, longest first.  Pieces of one length form a bucket; each piece is a sequence
of its own, so a sequence has one document and no padding, and a batch is filled
from one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import positions
from .word_ids import Encoder

LIMIT = 2048                # longest sequence, a power of two
END = 1                     # id after each document
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"

_PIECES = 1 << 22           # bytes of ids handed on at once


def cut(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, limit: int = LIMIT,
           end: int = END) -> DataFrame:
    """(key, row, start, length, ids, doc_tokens): the pieces of every document.

    ``ids`` are little-endian unsigned 32-bit numbers.  A null or empty text is the end id
    alone.  Repeated rows and null keys are documents of their own, told apart by
    ``row``.  Other columns are left out.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    names = ["key", "row", "start", "length", "ids", "doc_tokens"]
    schema = (f"key {docs.schema[key].dataType.simpleString()}, row bigint, start bigint, length bigint, "
              "ids binary, doc_tokens bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            source, starts, bodies, totals, held = [], [], [], [], 0
            for i, found in enumerate(encoder.encode(body.as_py() or "" for body in batch["text"])):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                at = 0
                for n in cut(len(ids), limit):
                    source.append(i)
                    starts.append(at)
                    bodies.append(ids[at:at + n].tobytes())
                    totals.append(len(ids))
                    at += n
                held += 4 * len(ids)
                if held > _PIECES or i + 1 == batch.num_rows:
                    taken = pa.array(source, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch["key"].take(taken), batch["row"].take(taken), pa.array(starts, pa.int64()),
                         pa.array([len(b) // 4 for b in bodies], pa.int64()), pa.array(bodies, pa.binary()),
                         pa.array(totals, pa.int64())], names=names)
                    source, starts, bodies, totals, held = [], [], [], [], 0

    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)


def sequences(cut_pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give every piece its sequence: ``sequence_id``, ``offset`` (0) and ``place`` in the bucket of its length.

    Sequences are numbered from 0 without a gap, longest bucket first, and within
    a bucket by document and start, so that numbers don't depend on how rows are
    dealt to tasks.  Other columns of the pieces are kept.
    """
    rows = materialise(cut_pieces.withColumn("bucket", -F.col("length")))
    placed = positions(rows, ["bucket"], [key, "doc_tokens", "start", "row"], "place", "held")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))             # a row for each power of two
    first = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    return (placed.join(F.broadcast(sizes.select("bucket", first.alias("first"))), "bucket").withColumn("sequence_id", F.col("first") + F.col("place"))
            .withColumn("offset", F.lit(0).cast("bigint")).drop("bucket", "held", "first"))


def write_buckets(docs: DataFrame, path: str, tokens: int = 1 << 16, key: str = "doc_id", text: str = "text",
                  tokenizer: str = TOKENIZER, limit: int = LIMIT, end: int = END) -> None:
    """Write the sequences of ``docs``, a folder for each length, with the batch that each one is in.

    A batch holds ``tokens`` ids of one length (the last one of a bucket may hold less).
    """
    placed = sequences(pieces(docs, key, text, tokenizer, limit, end), key)
    batch = F.expr(f"place DIV greatest({tokens} DIV length, 1)")
    (placed.withColumn("batch", batch).repartitionByRange("length", "sequence_id")
     .sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path))
