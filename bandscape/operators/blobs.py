"""Connected foreground regions (8-neighbourhood) and filters on them.

Labelling works in two steps: regions are found inside fixed-size tiles, on
runs instead of pixels; then only the regions that touch a tile border are
merged across tiles by iterated minimum labels with pointer jumping.  Pixels
are shuffled once, and the iterated graph is a small part of all runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tiles as tl
from ..functions.graph import components
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL
from .masks import near_flags

# A region is named after its first pixel in raster order: y · 2³² + x.
_ROW = 1 << 32


def _merge_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """Label the runs of one tile with the first pixel of their region."""
    runs = runs.sort_values(["y", "x0"], ignore_index=True)
    y, x0, x1 = (runs[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    # Runs of the next row that touch run i form a contiguous slice.
    first = np.searchsorted(y * _ROW + x1, (y + 1) * _ROW + x0 - 1)
    last = np.searchsorted(y * _ROW + x0, (y + 1) * _ROW + x1 + 1, side="right")
    degree = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(runs)), degree)
    lower = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(first, degree)
    root = np.arange(len(runs))
    while True:
        a, b = root[upper], root[lower]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    runs["region"] = (y * _ROW + x0)[root]
    return runs


def _tile_runs(mask: DataFrame, bits: int) -> DataFrame:
    """Runs of each tile with the tile's own region labels."""
    ink = tl.own_tiles(mask.filter(F.col("label") > 0).select(*PIXEL), bits)
    runs = (ink.withColumn("_island", F.col("x") - F.row_number().over(tl.along("x")))
            .groupBy(*tl.TILE, "y", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
            .drop("_island"))
    schema = T.StructType([*runs.schema.fields, T.StructField("region", T.LongType())])
    return runs.groupBy(*tl.TILE).applyInPandas(lambda part: _merge_runs(part), schema)


def _border_edges(runs: DataFrame, bits: int) -> DataFrame:
    """Distinct pairs of regions of different tiles that touch."""
    top, left = F.shiftleft("_ty", bits), F.shiftleft("_tx", bits)
    rim = (1 << bits) - 1
    row_end = F.col("y") == top + rim
    rows = F.sequence(F.greatest("x0", left), F.col("x1"))
    base = runs.select("scene_id", "region", "y", "x0", "x1", "_ty", "_tx")
    below = base.filter(row_end).select("scene_id", "region", (F.col("y") + 1).alias("y"), F.explode(rows).alias("x"))
    first_row = base.filter(F.col("y") == top).select("scene_id", F.col("region").alias("other"), "y",
                                                       F.explode(rows).alias("x"))
    right = base.filter(F.col("x1") == left + rim).select("scene_id", "region", "y", (F.col("x1") + 1).alias("x"))
    first_column = base.filter(F.col("x0") == left).select("scene_id", F.col("region").alias("other"), "y",
                                                            F.col("x0").alias("x"))

    def shifted(df, c):
        return df.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))

    met = shifted(below, "x").join(first_row, PIXEL).unionByName(shifted(right, "y").join(first_column, PIXEL))
    return met.filter(F.col("region") != F.col("other")).select("scene_id", "region", "other").distinct()


def _merge_regions(edges: DataFrame) -> DataFrame:
    """Smallest region connected to each region, as (scene_id, region, root)."""
    links = edges.select(F.struct("scene_id", "region").alias("a"), F.struct("scene_id", F.col("other").alias("region")).alias("b"))
    return components(links, "a", "b").select("node.scene_id", "node.region", F.col("label.region").alias("root"))


def label_runs(mask: DataFrame, bits: int = 9) -> DataFrame:
    """Foreground runs with the ``blob_id`` of their region."""
    runs = materialise(_tile_runs(mask, bits))
    edges = materialise(_border_edges(runs, bits))
    plain = runs.select("scene_id", "y", "x0", "x1", "region")
    if edges.isEmpty():
        return plain.withColumnRenamed("region", "blob_id")
    return (attach(plain, _merge_regions(edges), ["scene_id", "region"])
            .select("scene_id", "y", "x0", "x1", F.coalesce("root", "region").alias("blob_id")))


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def label_blobs(mask: DataFrame, bits: int = 9) -> DataFrame:
    """Foreground pixels with the id of their blob: its first pixel in raster order."""
    return run_pixels(label_runs(mask, bits)).select(*PIXEL, "blob_id")


def blob_areas(labelled: DataFrame) -> DataFrame:
    """Pixels per blob, from labelled pixels or labelled runs."""
    size = F.sum(F.col("x1") - F.col("x0") + 1) if "x0" in labelled.columns else F.count("*")
    return labelled.groupBy("scene_id", "blob_id").agg(size.alias("area"))


def isolation_limit(areas: DataFrame, share: float = 0.75) -> DataFrame:
    """Per scene: the area up to which a blob counts as small."""
    return areas.groupBy("scene_id").agg(F.rint(F.avg("area") * share).cast("bigint").alias("limit"))


def _runs_above(runs: DataFrame, limits: DataFrame | int) -> DataFrame:
    """Runs of blobs with an area above the limit.

    A blob is an arbitrary part of a scene, so its area comes back to the runs by
    the size-checked or salted join.
    """
    areas = blob_areas(runs)
    if isinstance(limits, int):
        large = areas.filter(F.col("area") > limits)
    else:
        large = attach(areas, limits, ["scene_id"]).filter(F.col("area") > F.col("limit"))
    return attach(runs, large.select("scene_id", "blob_id"), ["scene_id", "blob_id"], "inner")


def _on_grid(mask: DataFrame, kept: DataFrame) -> DataFrame:
    """The dense mask with label 0 where a foreground pixel was not kept."""
    rest = kept.select(*PIXEL).withColumn("_keep", F.lit(True))
    return (mask.join(rest, PIXEL, "left")
            .withColumn("label", F.when(F.col("_keep"), F.col("label")).otherwise(0).cast("smallint")).drop("_keep"))


def filter_blobs(mask: DataFrame, min_area: int = 20, bits: int = 9) -> DataFrame:
    """Clear blobs of at most ``min_area`` pixels from a dense mask."""
    runs = materialise(label_runs(mask, bits))
    return _on_grid(mask, run_pixels(_runs_above(runs, min_area)))


def filter_blobs_auto(mask: DataFrame, share: float = 0.75, bits: int = 9) -> DataFrame:
    """Clear blobs of up to ``share`` of the scene's mean blob area."""
    runs = materialise(label_runs(mask, bits))
    return _on_grid(mask, run_pixels(_runs_above(runs, isolation_limit(blob_areas(runs), share))))


def remove_isolated(mask: DataFrame, share: float = 0.75, d: float = 50, bits: int = 9) -> DataFrame:
    """Clear foreground pixels that are ``d`` or more away from every blob larger
    than ``share`` of the scene's mean blob area."""
    return clean_blobs(mask, 0, share, d, bits).select(
        *[c for c in mask.columns if c != "label"], F.col("base").alias("label"))


def clean_blobs(mask: DataFrame, min_area: int, share: float = 0.75, d: float = 50, bits: int = 9) -> DataFrame:
    """Both blob filters on one labelling of a dense mask: ``label`` without blobs
    of at most ``min_area`` pixels, and ``base`` with isolated blobs removed from it.

    Dropping whole blobs leaves the other ones as they are, so they are not
    labelled again.  The kept runs meet the mask in the tiles of the distance
    pass, so no join by pixel is needed.
    """
    runs = materialise(label_runs(mask, bits))
    kept = materialise(_runs_above(runs, min_area)) if min_area > 0 else runs
    areas = blob_areas(kept)
    large = (attach(areas, isolation_limit(areas, share), ["scene_id"]).filter(F.col("area") > F.col("limit"))
             .select("scene_id", "blob_id", F.lit(True).alias("anchor")))
    none = F.lit(False)
    rows = (mask.withColumns({"anchor": none, "_kept": none})       # a kept pixel is one more row, large or not
            .unionByName(run_pixels(attach(kept, large, ["scene_id", "blob_id"]))
                         .select(*PIXEL, F.coalesce("anchor", none).alias("anchor")).withColumn("_kept", F.lit(True)), allowMissingColumns=True))
    tile = tl.tile_bits(math.ceil(d))
    here = Window.partitionBy(*tl.TILE, "x").orderBy("y").rangeBetween(0, 0)        # the rows of one pixel
    flagged = near_flags(rows, d, tile).withColumn("_hit", F.max("_kept").over(here)).filter("label IS NOT NULL")
    label = F.when(F.col("_hit"), F.col("label")).otherwise(0).cast("smallint")
    return (tl.own_pixels(flagged, tile).withColumn("label", label)
            .withColumn("base", F.when(F.col("near"), F.col("label")).otherwise(0).cast("smallint"))
            .drop("anchor", "_kept", "_hit", "near"))
