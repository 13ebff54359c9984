"""Clustering of integer vectors around centroids, with N-simplex bounds.

The distances of a vector to several pivots are taken once.  They place it as the
apex of a simplex over the pivots: coordinates in the pivots' own space, and an
altitude above it.  For two such apexes, the distance of the coordinates and the
difference of the altitudes never exceed the Euclidean distance of the vectors,
and with the sum of the altitudes they never fall short of it.  In each round
these bounds rule out centroids; those left are compared by exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.runtime import materialise

SCALE = 1024
REACH = 1 << 27             # whole components are smaller, so squared distances of 64 of them are below 2**62
ROUGH = 1e-13               # relative rounding of a distance, taken far too high
FLAT = 0.05                 # a pivot this near to the others' space, relative to the widest gap, adds no coordinate


def whole_vectors(df: DataFrame, key: str, vector: str, dims: int = 64) -> DataFrame:
    """(key, v): vectors of ``dims`` components, none null or non-finite, as whole numbers floor(1024 x).

    Components from 131,072 on are left out as well, as their squared distances
    would not fit a long.  Null keys and repeated rows take part.
    """
    x = F.col(vector).cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < REACH // SCALE))
    return df.filter(F.coalesce(fits, F.lit(False))).select(
        F.col(key).alias("key"), F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, order: Column) -> np.ndarray:
    """The ``k`` vectors first in ``order``, ties by their components; fewer if there are no more."""
    rows = vectors.select("v", order.alias("_order")).orderBy(F.asc_nulls_last("_order"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Simplex(NamedTuple):
    """Pivots in general position and what turns squared distances to them into apexes."""

    pivots: np.ndarray      # whole vectors
    solve: np.ndarray       # coordinates from differences of squared distances
    square: np.ndarray      # squared distances of the pivots from the first one
    rough: float            # rounding of a coordinate for each unit of squared distance


def simplex(pivots: np.ndarray) -> Simplex:
    """Keep the pivots that span a simplex: those clearly outside of the space of the earlier ones."""
    gaps = (pivots - pivots[0]).astype(float)
    widest = np.sqrt((gaps ** 2).sum(1).max())
    axes, kept = np.zeros((0, pivots.shape[1])), []
    for i, gap in enumerate(gaps):
        out = gap - axes.T @ (axes @ gap)
        out -= axes.T @ (axes @ out)
        length = np.sqrt((out ** 2).sum())
        if i and length > FLAT * widest:
            axes, kept = np.vstack([axes, out / length]), [*kept, i]
    base = gaps[kept] @ axes.T                              # coordinates of the pivots but the first
    solve = np.linalg.inv(2 * base) if kept else np.zeros((0, 0))
    rough = ROUGH * np.abs(solve).sum() if kept else 0.0
    return Simplex(pivots[[0, *kept]], solve, (base ** 2).sum(1), rough)


def squared(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` from one whole vector."""
    gap = v - w
    return np.einsum("ij,ij->i", gap, gap)


def apexes(s: Simplex, v: np.ndarray) -> np.ndarray:
    """Coordinates, altitude and rounding of every row of ``v``."""
    d = np.stack([squared(v, p) for p in s.pivots], 1).astype(float)
    y = (d[:, :1] - d[:, 1:] + s.square) @ s.solve.T
    altitude = np.sqrt(np.maximum(d[:, 0] - (y ** 2).sum(1), 0))
    off = s.rough * (2 * d.max(1) + s.square.max(initial=0.0))
    far = np.sqrt(d[:, 0])
    slack = off + np.sqrt(2 * (far + off) * off + off * off + ROUGH * d[:, 0])
    return np.column_stack([y, altitude, slack])


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (smaller number on a tie), squared distance, and how many were compared exactly."""
    gap = ((apex[:, None, :-2] - tops[None, :, :-2]) ** 2).sum(2)
    a, b = apex[:, None, -2], tops[None, :, -2]
    slack = apex[:, None, -1] + tops[None, :, -1]
    low, high = np.sqrt(gap + (a - b) ** 2) - slack, np.sqrt(gap + (a + b) ** 2) + slack
    near = low <= high.min(1, keepdims=True)
    distance = np.full(near.shape, np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        rows = near[:, c]
        distance[rows, c] = squared(v[rows], centroid)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(v)), cluster], int(near.sum())


def _matrix(column: pa.Array, rows: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1)


def with_apexes(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Write the vectors with their apexes over the pivots."""
    s = simplex(pivots)
    schema = T.StructType([*vectors.schema.fields, T.StructField("apex", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apex = apexes(s, _matrix(batch["v"], batch.num_rows, np.int64))
                edges = pa.array(np.arange(0, apex.size + 1, apex.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(edges, pa.array(apex.ravel()))], names=schema.names)

    return materialise(vectors.mapInArrow(work, schema))


def _sums(placed: DataFrame, s: Simplex, centroids: np.ndarray) -> DataFrame:
    """(cluster, i, n, total): count and componentwise sums of each cluster, added up in the tasks first."""
    tops, dims = apexes(s, centroids), centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch["v"], batch.num_rows, np.int64)
                cluster = nearest(v, _matrix(batch["apex"], batch.num_rows, float), centroids, tops)[0]
                n += np.bincount(cluster, minlength=len(n))
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(some)), pa.int32()),
             pa.array(np.repeat(n[some], dims)), pa.array(total[some].ravel())], names=["cluster", "i", "n", "total"])

    parts = placed.select("v", "apex").mapInArrow(work, "cluster int, i int, n bigint, total bigint")
    return parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fit(placed: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds: each non-empty one becomes floor(sum / count) of its vectors.

    Only the sums of the clusters, ``k`` times ``dims`` numbers, reach the driver.
    """
    s, centroids = simplex(start), start.copy()
    for _ in range(rounds):
        before = centroids.copy()
        for row in _sums(placed, s, centroids).collect():
            centroids[row.cluster, row.i] = int(row.total) // row.n
        if (centroids == before).all():                     # later rounds would repeat this one
            break
    return centroids


def assign(placed: DataFrame, start: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    s = simplex(start)
    tops = apexes(s, centroids)
    schema = T.StructType([placed.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(_matrix(batch["v"], batch.num_rows, np.int64),
                                               _matrix(batch["apex"], batch.num_rows, float), centroids, tops)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                                 names=schema.names)

    return placed.mapInArrow(work, schema)


def cluster(vectors: DataFrame, order: Column, k: int = 8, rounds: int = 10) -> DataFrame:
    """Cluster whole ``vectors`` (key, v) around ``k`` centroids that start as the vectors first in ``order``.

    Returns key, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256.  With fewer than ``k`` vectors each of them is a centroid; an
    empty table gives no rows.  An inertia that doesn't fit a long is null.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors)
    start = first_centroids(vectors, k, order)
    if len(start) == 0:
        placed = vectors.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        centroids = start
    else:
        table = with_apexes(vectors, start)
        centroids = fit(table, start, rounds)
        placed = materialise(assign(table, start, centroids))
    own = {r.cluster: int(r.own) for r in placed.groupBy("cluster").agg(        # k rows at most
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    rows = [(c, _long(own.get(c, 0)), _long(sum(own.values())), sha256(",".join(map(str, row)).encode()).hexdigest())
            for c, row in enumerate(centroids.tolist())]
    model = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(model), "cluster").select(
        "key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None
