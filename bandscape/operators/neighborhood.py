"""Neighbourhood operators: contrast, local thresholds, median, erosion, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import tiles as tl
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL
from .bands import enhance_saturation, minmax_columns
from .stats import confidence, histogram, otsu

# Keeps the contrast of an all-black window at 0 (fixed value).
EPSILON = 1e-6


def local_contrast(df: DataFrame, value="value", radius: int = 1, bits: int | None = None) -> DataFrame:
    """``(max − min) / (max + min + ε)`` in a square window."""
    v = F.col(value)
    boxed = tl.box_aggregate(df, {"_mn": ("min", v), "_mx": ("max", v)}, radius, bits=bits)
    mn, mx = F.col("_mn").cast("double"), F.col("_mx").cast("double")
    return boxed.withColumn("contrast", (mx - mn) / (mx + mn + F.lit(EPSILON))).drop("_mn", "_mx")


def contrast_edges(contrast: DataFrame) -> DataFrame:
    """Flag ``edge``: 8-bit contrast above its Otsu threshold."""
    level = S.round_u8(F.col("contrast") * 255.0)
    binned = materialise(contrast.withColumn("_bin", level))     # read for the histogram and for the flag
    cut = otsu(histogram(binned, "_bin"))
    return (attach(binned, cut, ["scene_id"])
            .withColumn("edge", F.col("_bin") > F.col("threshold")).drop("_bin", "threshold"))


def peak_gaps(edges: DataFrame) -> DataFrame:
    """How often each distance between neighbouring edge pixels of a row occurs."""
    row = Window.partitionBy("scene_id", "y").orderBy("x")      # one image row
    return (edges.filter("edge").select(*PIXEL)
            .withColumn("dist", F.col("x") - F.lag("x").over(row)).filter("dist IS NOT NULL")
            .groupBy("scene_id", "dist").agg(F.count("*").alias("n")))


def stroke_width(edges: DataFrame, default: int = 1) -> DataFrame:
    """Most frequent distance between neighbouring edge pixels of a row; the
    smaller one wins a tie.  Scenes without two edges in a row get ``default``."""
    widths = peak_gaps(edges).groupBy("scene_id").agg(
        F.max_by("dist", F.struct("n", (-F.col("dist")).alias("small"))).alias("stroke_width"))
    scenes = edges.groupBy("scene_id").agg(F.max("y").alias("_"))
    return scenes.join(widths, "scene_id", "left").select(
        "scene_id", F.coalesce("stroke_width", F.lit(default)).alias("stroke_width"))


def local_threshold(df: DataFrame, radius: int | Column, n_min: int | Column, value="value",
                    bits: int | None = None) -> DataFrame:
    """Ink test against the edge pixels around each pixel.

    A pixel is ink if its window holds at least ``n_min`` edge pixels and its
    value is at most their mean plus half their standard deviation.  Radius and
    minimum may be columns that are constant within a scene.
    """
    edge = F.when(F.col("edge"), 1).otherwise(0).cast("bigint")
    v = F.col(value).cast("bigint")
    boxed = tl.box_aggregate(df, {"n_edge": ("sum", edge), "_s": ("sum", edge * v), "_q": ("sum", edge * v * v)},
                             radius, bits=bits)
    n = F.when(F.col("n_edge") > 0, F.col("n_edge").cast("double"))
    mean = F.col("_s") / n
    std = F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)))
    threshold = mean + std / 2.0
    enough = F.col("n_edge") >= (F.lit(n_min) if isinstance(n_min, int) else n_min)
    return (boxed.withColumn("threshold", threshold)
            .withColumn("label", F.when(enough & (F.col(value) <= F.col("threshold")), 255).otherwise(0).cast("smallint"))
            .drop("_s", "_q"))


def median_smooth(df: DataFrame, value="label", size: int = 5, bits: int | None = None) -> DataFrame:
    """Median of a ``size`` × ``size`` window with replicated borders."""
    r = size // 2
    bits = tl.tile_bits(r) if bits is None else bits
    tiled = tl.own_pixels(_median(tl.halo_tiles(df, r, bits), value, r), bits)
    return tiled.withColumn(value, F.col("_median")).drop("_median")


def _median(tiled: DataFrame, value: str, r: int) -> DataFrame:
    """Add ``_median`` to a tiled dense image: neighbours are looked up along the
    row, then whole row arrays along the column; a lookup beyond the border
    repeats the outermost value."""

    def neighbours(c: Column, axis: str) -> list[Column]:
        w = tl.along(axis)
        out = [c]
        for side in (F.lag, F.lead):
            last = c
            for k in range(1, r + 1):
                last = F.coalesce(side(c, k).over(w), last)
                out.append(last)
        return out

    rows = tiled.withColumn("_row", F.array(*neighbours(F.col(value), "x")))
    boxes = rows.withColumn("_box", F.concat(*neighbours(F.col("_row"), "y")))
    middle = ((2 * r + 1) ** 2) // 2
    return boxes.withColumn("_median", F.sort_array("_box")[middle]).drop("_row", "_box")


def remove_sensor_noise(df: DataFrame, value="value", bits: int | None = None) -> DataFrame:
    """Clamp each image to the range of its 5×5 median, then stretch it; images
    whose median spans 0..255 stay as they are."""
    bits = tl.tile_bits(2) if bits is None else bits
    medians = tl.own_pixels(_median(tl.halo_tiles(df, 2, bits), value, 2), bits)
    bounds = medians.groupBy("scene_id").agg(F.min("_median").alias("_mn"), F.max("_median").alias("_mx"))
    v = F.col(value)
    bounded = attach(df, bounds, ["scene_id"]).withColumn(
        "_c", F.least(F.greatest(v, F.col("_mn")), F.col("_mx")))
    done = minmax_columns(bounded, ["scene_id"], {"_s": F.col("_c")})
    full = (F.col("_mn") == 0) & (F.col("_mx") == 255)
    return done.withColumn(value, F.when(full, v).otherwise(F.col("_s")).cast("smallint")).drop("_mn", "_mx", "_c", "_s")


def erosion_depth(mask: DataFrame, cap: int, label="label", bits: int | None = None) -> DataFrame:
    """City-block distance of each pixel to the nearest background pixel, up to ``cap``.

    ``n`` erosions with the 5-pixel cross keep exactly the pixels with a depth
    above ``n``, so one distance pass replaces any number of erosions.  Pixels
    outside the image do not count as background.
    """
    bits = tl.tile_bits(cap) if bits is None else bits
    t = tl.halo_tiles(mask, cap, bits)
    x, y, far = F.col("x"), F.col("y"), F.lit(cap)
    hole = F.when(F.col(label) == 0, x)
    fore = tl.along("x").rowsBetween(Window.unboundedPreceding, 0)
    back = tl.against("x").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_l": F.max(hole).over(fore), "_r": F.min(hole).over(back)})
    t = t.withColumn("_g", F.least(F.coalesce(x - F.col("_l"), far), F.coalesce(F.col("_r") - x, far), far))
    down = tl.along("y").rowsBetween(Window.unboundedPreceding, 0)
    up = tl.against("y").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"_u": F.min(F.col("_g") - y).over(down), "_d": F.min(F.col("_g") + y).over(up)})
    depth = F.least(F.col("_u") + y, F.col("_d") - y, far)
    return tl.own_pixels(t.withColumn("depth", depth).drop("_l", "_r", "_g", "_u", "_d"), bits)


def erode(mask: DataFrame, n: int = 1, label="label", bits: int | None = None) -> DataFrame:
    """``n`` erosions of a binary mask with the 5-pixel cross."""
    return (erosion_depth(mask, n + 1, label, bits)
            .withColumn(label, F.when(F.col("depth") > n, F.col(label)).otherwise(0).cast("smallint")).drop("depth"))


def erode_border(mask: DataFrame, size: int = 18, label="label", bits: int | None = None) -> DataFrame:
    """Minimum over a square of ``size`` pixels, anchored at its middle.

    A constant mask stays as it is, as the minimum of a constant is itself.
    """
    eroded = tl.box_aggregate(mask, {"_mn": ("min", F.col(label))}, size // 2, size - 1 - size // 2, bits)
    return eroded.withColumn(label, F.col("_mn")).drop("_mn")


def row_runs(mask: DataFrame) -> DataFrame:
    """Foreground runs per image row: ``(scene_id, y, x0, x1)``."""
    row = Window.partitionBy("scene_id", "y").orderBy("x")      # one image row
    return (mask.filter(F.col("label") > 0).select(*PIXEL)
            .withColumn("_island", F.col("x") - F.row_number().over(row))
            .groupBy("scene_id", "y", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
            .drop("_island"))


def binarise_local(df: DataFrame, value="value", stroke: int | None = None, median: int | None = None,
                   bits: int | None = None) -> DataFrame:
    """Local-contrast binarisation of one grey image per scene.

    Edges are contrast peaks above Otsu's threshold; the stroke width is the
    usual distance between them and serves as window radius and as the least
    number of edges.  A given ``stroke`` skips that estimate.
    """
    kept = [c for c in df.columns if c not in ("contrast", "edge")]
    edges = contrast_edges(local_contrast(df, value, bits=bits))
    if stroke is None:
        edges = attach(edges, stroke_width(edges), ["scene_id"])
        radius, least = F.coalesce("stroke_width", F.lit(1)), F.col("stroke_width")
    else:
        radius, least = stroke, stroke
    found = local_threshold(edges, radius, least, value, bits)
    if median:
        found = median_smooth(found, "label", median, bits)
    return found.select(*kept, "contrast", "label")


def box_mean(df: DataFrame, size: int, value="value", out="mean", bits: int | None = None) -> DataFrame:
    """Mean over a square of ``size`` pixels, cut at the image border."""
    before, after = size // 2, size - 1 - size // 2
    boxed = tl.box_aggregate(df, {"_s": ("sum", F.col(value)), "_n": ("sum", F.lit(1))}, before, after, bits)
    return boxed.withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def foreground_estimate(df: DataFrame, size: int = 32, slope: float = 15.0, value="value",
                        bits: int | None = None) -> DataFrame:
    """Fade out pixels that are not darker than their surroundings: a pixel keeps
    its value to the extent of its sigmoid weight and turns white otherwise."""
    around = box_mean(df, size, value, "_mean", bits)
    weight = S.sigmoid(F.col(value) / 255.0, F.col("_mean") / 255.0, slope)
    faded = F.lit(255.0) - weight * (F.lit(255.0) - F.col(value))
    return around.withColumn("weighted", S.round_u8(faded)).drop("_mean")


def binarise_weighted(df: DataFrame, size: int = 32, slope: float = 15.0, stroke: int | None = 3, value="value",
                      bits: int | None = None) -> DataFrame:
    """Local binarisation of the foreground estimate."""
    return binarise_local(foreground_estimate(df, size, slope, value, bits), "weighted", stroke, bits=bits)


def binarise_color(df: DataFrame, sensitivity: float = 0.5, threshold: float = 0.1, size: int = 32,
                   slope: float = 15.0, stroke: int | None = 3, bits: int | None = None) -> DataFrame:
    """Colour binarisation: per scene the saturation-enhanced result if its
    confidence reaches ``threshold``, else the plain one."""
    both = enhance_saturation(enhance_saturation(df, 0.0, out="_plain"), sensitivity, out="_rich")
    keep = [*PIXEL]
    rich, plain = (materialise(binarise_weighted(both.select(*keep, F.col(c).alias("value")), size, slope, stroke, bits=bits)
                         .select(*keep, "contrast", "label")) for c in ("_rich", "_plain"))
    trust = confidence(rich).select("scene_id", (F.col("confidence") >= threshold).alias("_rich"))
    # Each scene keeps one side, so no pixel join is needed.
    return (attach(rich, trust, ["scene_id"]).filter("_rich")
            .unionByName(attach(plain, trust, ["scene_id"]).filter("NOT _rich"))
            .select(*keep, "label", F.col("_rich").alias("enhanced")))
