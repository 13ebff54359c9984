"""Mask algebra and joins by pixel position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as tl
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..functions.scalar import stretch
from ..schema import PIXEL
from .bands import minmax_columns, to_gray
from .neighborhood import erode_border


def neighbor_pairs(df: DataFrame, columns: list[str], bits: int = 8) -> DataFrame:
    """All pairs of 8-neighbours, each once: the pixel, the offset, and both
    pixels' ``columns`` (the second one's with suffix ``_n``).

    A pair lies on a row, a column or a diagonal, so each direction is a lookup
    of the next row on that line of the tile; nothing is joined or copied but
    the one-pixel tile rims.
    """
    tiled = tl.halo_tiles(df.select(*PIXEL, *columns), 1, bits)
    y, x = F.col("y"), F.col("x")
    here = F.struct("y", "x", *columns)

    def next_on(line: Column, order: str, dy: int, dx: int) -> Column:
        # Lookup along one line; it counts only if it is the direct neighbour.
        after = F.lead(here).over(Window.partitionBy(*tl.TILE, line).orderBy(order))
        near = (after["y"] == y + dy) & (after["x"] == x + dx)
        return F.when(near, F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"),
                                     *[after[c].alias(f"{c}_n") for c in columns]))

    pairs = tiled.withColumns({
        "_e": next_on(y, "x", 0, 1), "_s": next_on(x, "y", 1, 0),
        "_se": next_on(x - y, "y", 1, 1), "_sw": next_on(x + y, "y", 1, -1)})
    return (tl.own_pixels(pairs, bits)
            .select(*PIXEL, *columns, F.explode(F.array("_e", "_s", "_se", "_sw")).alias("_p"))
            .filter("_p IS NOT NULL").select(*PIXEL, *columns, "_p.*"))


def contrast_scale(features: DataFrame, columns=("c0", "c1", "c2"), bits: int = 8) -> DataFrame:
    """``β = 1 / (2 · mean‖Δ‖²)`` over 8-neighbour pairs; 0 on constant scenes."""
    columns = list(columns)
    pairs = neighbor_pairs(features, columns, bits)
    square = sum(((F.col(c).cast("bigint") - F.col(f"{c}_n").cast("bigint"))
                  * (F.col(c).cast("bigint") - F.col(f"{c}_n").cast("bigint")) for c in columns), F.lit(0))
    sums = pairs.groupBy("scene_id").agg(F.sum(square).alias("_s"), F.count("*").alias("_n"))
    mean = F.col("_s") / F.col("_n").cast("double")
    return sums.select("scene_id", F.coalesce(1.0 / (2.0 * F.when(mean > 0, mean)), F.lit(0.0)).alias("beta"))


RUN_BLOCK = 256


def run_edges(runs: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """Pairs of runs in consecutive rows that touch (gap of at most one pixel).

    Rows are cut into blocks of columns, so a join bucket holds one block of two
    rows; the pair is taken in the block where its contact begins, hence once.
    """
    def blocked(df, low, high):
        return df.withColumn("_b", F.explode(F.sequence(F.floor(low / block), F.floor(high / block))))

    upper = blocked(runs.select("scene_id", "y", F.col("x0").alias("ax0"), F.col("x1").alias("ax1")),
                    F.col("ax0") - 1, F.col("ax1") + 1)
    lower = blocked(runs.select("scene_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1")),
                    F.col("bx0"), F.col("bx1"))
    touch = (F.col("bx0") <= F.col("ax1") + 1) & (F.col("bx1") >= F.col("ax0") - 1)
    start = F.floor(F.greatest(F.col("ax0") - 1, F.col("bx0")) / block)
    return (upper.join(lower, ["scene_id", "y", "_b"]).filter(touch & (F.col("_b") == start))
            .select("scene_id", "y", "ax0", "ax1", "bx0", "bx1"))


def near_flags(rows: DataFrame, d: float, bits: int | None = None) -> DataFrame:
    """Add ``near`` to the rows of a dense image: is an ``anchor`` row closer than ``d``?

    Exact and without pairing pixels: the distance ``g`` to the nearest anchor
    of the same row says how many rows up and down that anchor still reaches in
    this column; running extremes of those reaches answer every pixel.  Anchor
    rows may come in addition to the image's own rows.  The result stays tiled.
    """
    far = math.ceil(d) - 1 if d > 0 else 0              # largest whole distance below d
    t = tl.halo_tiles(rows, far, tl.tile_bits(far) if bits is None else bits)
    x, y = F.col("x"), F.col("y")
    spot = F.when(F.col("anchor"), x)
    upto = (Window.unboundedPreceding, 0)               # range frame: rows at the same place count
    t = t.withColumns({"_l": F.max(spot).over(tl.along("x").rangeBetween(*upto)),
                       "_r": F.min(spot).over(tl.against("x").rangeBetween(*upto))})
    g = F.least(x - F.col("_l"), F.col("_r") - x)
    room = F.lit(float(d) * float(d)) - (g * g).cast("double")      # reach² must be below it
    reach = F.when(room > 0, (F.ceil(F.sqrt(room)) - 1).cast("int"))
    # Guard the root against rounding at perfect squares.
    reach = F.when(((reach + 1) * (reach + 1)).cast("double") < room, reach + 1).when(
        (reach * reach).cast("double") >= room, reach - 1).otherwise(reach)
    t = t.withColumn("_h", reach).withColumns({
        "_down": F.max(y + F.col("_h")).over(tl.along("y").rangeBetween(*upto)),
        "_up": F.min(y - F.col("_h")).over(tl.against("y").rangeBetween(*upto))})
    near = F.coalesce(F.col("_down") >= y, F.lit(False)) | F.coalesce(F.col("_up") <= y, F.lit(False))
    return t.withColumn("near", near).drop("_l", "_r", "_h", "_down", "_up")


def keep_near(mask: DataFrame, anchors: DataFrame, d: float = 50, bits: int | None = None) -> DataFrame:
    """Foreground pixels of a dense mask closer than ``d`` to an anchor pixel."""
    bits = tl.tile_bits(math.ceil(d)) if bits is None else bits
    rows = mask.select(*PIXEL, "label").withColumn("anchor", F.lit(False)).unionByName(
        anchors.select(*PIXEL).withColumn("anchor", F.lit(True)), allowMissingColumns=True)
    flagged = near_flags(rows, d, bits).filter((F.col("label") > 0) & ~F.col("anchor"))
    return tl.own_pixels(flagged, bits).filter("near").select(*PIXEL, "label")


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that are positive in both masks."""
    positive = F.col("label") > 0
    return (a.filter(positive).select(*PIXEL)
            .join(b.filter(positive).select(*PIXEL), PIXEL, "left_semi")
            .withColumn("label", F.lit(255).cast("smallint")))


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that are positive in ``a`` and not in ``b``."""
    positive = F.col("label") > 0
    return a.filter(positive).select(*PIXEL).join(b.filter(positive).select(*PIXEL), PIXEL, "left_anti")


def reconcile(a: DataFrame, b: DataFrame, columns: list[str], keys=PIXEL) -> DataFrame:
    """Per scene and image column: signed sum of differences over matched pixels,
    and the pixels that only one side has.

    Both sides are stacked and grouped by pixel, which is one hash aggregation
    instead of a full outer sort-merge join.
    """
    def side(df, sign):
        return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_side", F.lit(sign))

    left, right = F.col("_side") == 1, F.col("_side") == -1
    matched = (side(a, 1).unionByName(side(b, -1)).groupBy(*keys)
               .agg(F.count_if(left).alias("_a"), F.count_if(right).alias("_b"),
                    *[F.sum(F.col(c) * F.col("_side")).alias(c) for c in columns]))
    both = (F.col("_a") > 0) & (F.col("_b") > 0)
    totals = matched.groupBy("scene_id").agg(
        F.count_if(both).alias("matched"), F.count_if(F.col("_b") == 0).alias("only_a"),
        F.count_if(F.col("_a") == 0).alias("only_b"),
        *[F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0.0)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("image"), F.col(c).alias("difference")) for c in columns])
    return totals.select("scene_id", "matched", "only_a", "only_b", F.inline(cells))


def derived_images(df: DataFrame, border: int = 18, bits: int | None = None) -> DataFrame:
    """The derived images of a colour page with mask: colour, mask, grey and eroded
    mask, on the 8-bit and on the unit scale, and stretched."""
    kept = to_gray(df).withColumn("eroded_mask", F.col("label"))
    eroded = erode_border(kept, border, "eroded_mask", bits).withColumnsRenamed({"label": "mask"})
    unit = eroded.withColumns({f"{c}_unit": F.col(c) / F.lit(255.0) for c in ("gray", "mask", "eroded_mask")})
    # The colour image is stretched over all its channels at once.
    lo, hi = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    ranges = unit.groupBy("scene_id").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    colour = attach(unit, ranges, ["scene_id"]).withColumns(
        {f"{c}_norm": stretch(F.col(c), F.col("_lo"), F.col("_hi"), 0.0, 1.0) for c in ("r", "g", "b")})
    return minmax_columns(colour.drop("_lo", "_hi"), ["scene_id"], {"gray_norm": F.col("gray")}, 0.0, 1.0, False)


def balanced_sample(table: DataFrame, n: int = 1000, rows: int = 1024, columns: int = 4096) -> DataFrame:
    """Equally many foreground (255) and background (0) pixels per scene, evenly
    spaced in raster order; other labels take no part.

    The raster position is the number of earlier pixels of the class: counts per
    row strip are added up within blocks of rows and then over the blocks, so no
    task sorts a whole scene.
    """
    labelled = table.filter(F.col("label").isin(0, 255)).withColumns(
        {"_yb": F.floor(F.col("y") / rows), "_xb": F.floor(F.col("x") / columns)})
    block, strip = ["scene_id", "label", "_yb"], ["scene_id", "label", "_yb", "y", "_xb"]
    strips = materialise(labelled.groupBy(*strip).agg(F.count("*").alias("_c")))
    blocks = strips.groupBy(*block).agg(F.sum("_c").alias("_c"))
    above = Window.partitionBy("scene_id", "label").orderBy("_yb")              # one row per block
    starts = blocks.select(*block, (F.sum("_c").over(above) - F.col("_c")).alias("_before"))
    earlier = Window.partitionBy(*block).orderBy("y", "_xb")                    # strips of one block
    offsets = (attach(strips.withColumn("_within", F.sum("_c").over(earlier) - F.col("_c")), starts, block, "inner",
                      bounded=True)
               .select(*strip, "_c", (F.col("_before") + F.col("_within")).alias("_start")))
    sizes = (blocks.groupBy("scene_id")
             .agg(F.sum(F.when(F.col("label") == 255, F.col("_c"))).alias("_pos"),
                  F.sum(F.when(F.col("label") == 0, F.col("_c"))).alias("_neg"))
             .filter("_pos > 0 AND _neg > 0")
             .select("scene_id", "_pos", "_neg", F.least(F.lit(n).cast("bigint"), "_pos", "_neg").alias("_take")))
    # Only strips that hold a wanted position are ranked: at most 2 n a scene.
    total = F.when(F.col("label") == 255, F.col("_pos")).otherwise(F.col("_neg"))
    next_i = F.expr("(_start * _take + _total - 1) DIV _total")
    wanted = (attach(offsets, sizes, ["scene_id"], "inner").withColumn("_total", total).withColumn("_next", next_i)
              .filter("_next < _take AND (_next * _total) DIV _take < _start + _c")
              .select(*strip, "_start", "_take", "_total"))
    inside = Window.partitionBy(*strip).orderBy("x")
    placed = (attach(labelled, wanted, strip, "inner", bounded=True)        # the window below needs whole strips, too
              .withColumn("_p", F.col("_start") + F.row_number().over(inside) - F.lit(1)))
    # Position p is taken if it is floor(i * total / take) for a whole i below take.
    i = F.expr("(_p * _take + _total - 1) DIV _total")
    taken = placed.withColumn("_i", i).filter("_i < _take AND (_i * _total) DIV _take = _p")
    return taken.select(*table.columns)
