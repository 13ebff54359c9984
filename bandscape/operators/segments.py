"""Line segments ``(x0, y0) – (x1, y1)``: attributes, rotation, crossings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach

# Slope of a vertical segment: the largest 32-bit float (fixed value).
VERTICAL = 3.4028234663852886e38

_ENDS = ["x0", "y0", "x1", "y1"]


def _slope() -> Column:
    dx = F.col("x1") - F.col("x0")
    return F.coalesce((F.col("y1") - F.col("y0")) / F.when(dx != 0, dx), F.lit(VERTICAL))


def ordered(segments: DataFrame) -> DataFrame:
    """Put the end point with the smaller x first; equal x swaps the ends."""
    kept = F.col("x0") < F.col("x1")
    pick = lambda a, b: F.when(kept, F.col(a)).otherwise(F.col(b))
    return segments.withColumns({"x0": pick("x0", "x1"), "y0": pick("y0", "y1"),
                                 "x1": pick("x1", "x0"), "y1": pick("y1", "y0")})


def segment_attrs(segments: DataFrame, swap_axes: bool = False) -> DataFrame:
    """Ordered ends, slope, length and centre; optionally with x and y swapped."""
    out = ordered(segments).withColumn("slope", _slope())
    if swap_axes:
        out = out.withColumns({"x0": F.col("y0"), "y0": F.col("x0"), "x1": F.col("y1"), "y1": F.col("x1")})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return out.withColumns({"length": F.sqrt(dx * dx + dy * dy),
                            "cx": F.col("x0") + dx * 0.5, "cy": F.col("y0") + dy * 0.5})


def rotate_segments(segments: DataFrame, cx: float, cy: float, angle: float) -> DataFrame:
    """Rotate ordered segments about ``(cx, cy)`` and recompute the slope."""
    cos, sin = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    done = {}
    for i in "01":
        dx, dy = F.col(f"x{i}") - cx, F.col(f"y{i}") - cy
        done |= {f"x{i}": dx * cos - dy * sin + cx, f"y{i}": dx * sin + dy * cos + cy}
    return ordered(segments).withColumns(done).withColumn("slope", _slope())


def extend_segments(segments: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Prolong each segment to the border of a box."""
    seg = ordered(segments)
    sx, sy = F.col("x0"), F.col("y0")
    gx, gy = F.col("x1") - sx, F.col("y1") - sy
    safe_x, safe_y = F.when(gx != 0, gx), F.when(gy != 0, gy)
    rising = gx * gy < 0

    def border(x_edge: float, y_edge: Column) -> tuple[Column, Column]:
        """Where the line leaves towards the corner ``(x_edge, y_edge)``."""
        run, rise = F.lit(float(x_edge)) - sx, y_edge - sy
        steep = F.coalesce(F.abs(gy / safe_x) > F.abs(rise / F.when(run != 0, run)), F.lit(False))
        return (F.when(steep, sx + gx / safe_y * rise).otherwise(F.lit(float(x_edge))),
                F.when(steep, y_edge).otherwise(sy + gy / safe_x * run))

    lit = lambda v: F.lit(float(v))
    end = border(right, F.when(rising, lit(top)).otherwise(lit(bottom)))
    start = border(left, F.when(rising, lit(bottom)).otherwise(lit(top)))
    flat_left, flat_right = min(left, right), max(left, right)

    def cases(vertical, horizontal, general):
        return F.when(gx == 0, vertical).when(gy == 0, horizontal).otherwise(general)

    return (seg.withColumn("_p", F.struct(
                cases(sx, lit(flat_left), start[0]).alias("x0"), cases(lit(bottom), sy, start[1]).alias("y0"),
                cases(sx, lit(flat_right), end[0]).alias("x1"), cases(lit(top), sy, end[1]).alias("y1")))
            .withColumns({c: F.col(f"_p.{c}") for c in _ENDS}).drop("_p")
            .withColumn("slope", _slope()))


def segment_pairs(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Crossing point and end-to-start distance of given pairs ``(scene_id, id1, id2)``.

    The candidate pairs are an input, joined by key: a scene's segments are never
    all paired with each other.  Parallel segments have no crossing point.
    """
    seg = ordered(segments).select("scene_id", "seg_id", *_ENDS)
    first = seg.select("scene_id", F.col("seg_id").alias("id1"), *[F.col(c).alias(f"a{c}") for c in _ENDS])
    second = seg.select("scene_id", F.col("seg_id").alias("id2"), *[F.col(c).alias(f"b{c}") for c in _ENDS])
    both = pairs.select("scene_id", "id1", "id2").join(first, ["scene_id", "id1"]).join(second, ["scene_id", "id2"])
    g1x, g1y = F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0")
    g2x, g2y = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    cross = g1x * g2y - g1y * g2x
    t = ((F.col("bx0") - F.col("ax0")) * g2y - (F.col("by0") - F.col("ay0")) * g2x) / F.when(cross != 0, cross)
    ex, ey = F.col("ax1") - F.col("bx0"), F.col("ay1") - F.col("by0")
    return both.select("scene_id", "id1", "id2",
                       (F.col("ax0") + t * g1x).alias("px"), (F.col("ay0") + t * g1y).alias("py"),
                       F.sqrt(ex * ex + ey * ey).alias("distance"), (ex * ex + ey * ey).alias("distance_sq"))


def segment_axis_hits(segments: DataFrame, axes: DataFrame) -> DataFrame:
    """Where segments meet the line x = c or y = c of their scene
    (``axes``: scene_id, axis, c); parallel ones have no point."""
    seg = ordered(segments).select("scene_id", "seg_id", *_ENDS)
    both = attach(seg, axes.select("scene_id", "axis", "c"), ["scene_id"], "inner")
    sx, sy, c = F.col("x0"), F.col("y0"), F.col("c")
    gx, gy = F.col("x1") - sx, F.col("y1") - sy
    upright = F.col("axis") == "x"
    parallel = F.when(upright, gx == 0).otherwise(gy == 0)
    px = F.when(upright, c).otherwise(sx + (c - sy) * gx / F.when(gy != 0, gy))
    py = F.when(upright, sy + (c - sx) * gy / F.when(gx != 0, gx)).otherwise(c)
    return both.select("scene_id", "seg_id", "axis", "c",
                       F.when(~parallel, px).alias("px"), F.when(~parallel, py).alias("py"))
