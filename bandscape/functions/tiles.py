"""Two-dimensional windows over pixel tables in one shuffle.

A scene is cut into square tiles; a pixel closer than ``reach`` to a tile border
is also copied to the tile behind it.  After one shuffle on (scene, tile), every
neighbourhood of a tile's own pixels is complete inside the tile, and any number
of row and column windows run without another shuffle, since a partitioning on
(scene, tile) also clusters (scene, tile, y) and (scene, tile, x).  A tile has a
fixed size, so no window ever holds a whole scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TILE = ["scene_id", "_ty", "_tx"]
_SCALE = 1 << 40


def tile_bits(reach: int | None = None) -> int:
    """log2 of the tile edge: 256 pixels, or more when the reach is large."""
    bits = 8
    while reach is not None and (1 << bits) < 4 * reach:
        bits += 1
    return bits


def to_tiles(df: DataFrame, most: int | None = None) -> DataFrame:
    """One shuffle on (scene, tile).  The number of partitions is the session's, or
    ``most`` if that is less: window and array work is bound by processors, while
    merging partitions at run time would go by their bytes."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts if most is None else min(parts, most), *TILE)


def radius_bits(radius: Column) -> Column:
    """log2 of the tile edge for a radius that is constant within a scene: 512
    pixels, or the first power of two from twice the radius on."""
    return F.greatest(F.lit(9), F.ceil(F.log2(2 * F.greatest(radius, F.lit(1))))).cast("int")


def _tile(c: str | Column, bits: int | str) -> Column:
    """Tile of a coordinate; ``bits`` is a number or the name of a column."""
    edge = F.lit(1 << bits) if isinstance(bits, int) else F.expr(f"shiftleft(1, {bits})")
    return F.floor((F.col(c) if isinstance(c, str) else c) / edge).cast("int")


def own_tiles(df: DataFrame, bits: int) -> DataFrame:
    """Shuffle every pixel to its own tile, without copies."""
    return to_tiles(df.withColumn("_ty", F.shiftright("y", bits)).withColumn("_tx", F.shiftright("x", bits)))


def halo_tiles(df: DataFrame, reach: int | Column, bits: int | str) -> DataFrame:
    """Shuffle pixels to their tile and to every tile within ``reach`` of them."""
    reach = F.lit(reach) if isinstance(reach, int) else reach

    def touched(c: str) -> Column:
        low = _tile(F.greatest(F.col(c) - reach, F.lit(0)), bits)
        return F.explode(F.sequence(low, _tile(F.col(c) + reach, bits)))

    return to_tiles(df.withColumn("_ty", touched("y")).withColumn("_tx", touched("x")))


def own_pixels(df: DataFrame, bits: int | str) -> DataFrame:
    """Drop the copies again: each pixel survives only in its own tile."""
    inside = (_tile("y", bits) == F.col("_ty")) & (_tile("x", bits) == F.col("_tx"))
    return df.filter(inside).drop("_ty", "_tx")


def along(axis: str) -> WindowSpec:
    """Window over one row (``axis='x'``) or one column (``axis='y'``) of a tile."""
    line = "y" if axis == "x" else "x"
    return Window.partitionBy(*TILE, line).orderBy(axis)


def against(axis: str) -> WindowSpec:
    """As :func:`along`, in descending order."""
    line = "y" if axis == "x" else "x"
    return Window.partitionBy(*TILE, line).orderBy(F.desc(axis))


def _framed(axis: str, before, after) -> WindowSpec:
    if isinstance(before, int):
        return along(axis).rangeBetween(-before, after)
    # Radius per row (constant within a scene): scale the ordering so that a
    # distance of at most the radius is a distance of at most a constant.  This
    # is exact for radii and coordinates below a million.
    line = "y" if axis == "x" else "x"
    key = F.col(axis).cast("bigint") * F.floor(F.lit(_SCALE) / before)
    return Window.partitionBy(*TILE, line).orderBy(key).rangeBetween(-_SCALE, _SCALE)


def box_windows(df: DataFrame, measures: dict[str, tuple[str, Column]],
                before: int | Column, after: int | Column | None = None) -> DataFrame:
    """Separable aggregates (min, max, sum) over a rectangle around each pixel.

    ``df`` must already be tiled.  ``measures`` maps an output name to an
    aggregate and its input; the first pass aggregates along the row, the second
    one aggregates those results along the column.
    """
    after = before if after is None else after
    call = {"min": F.min, "max": F.max, "sum": F.sum}
    row, column = _framed("x", before, after), _framed("y", before, after)
    first = {f"_row_{name}": call[kind](value).over(row) for name, (kind, value) in measures.items()}
    second = {name: call[kind](F.col(f"_row_{name}")).over(column) for name, (kind, _) in measures.items()}
    return df.withColumns(first).withColumns(second).drop(*first)


def box_aggregate(df: DataFrame, measures: dict[str, tuple[str, Column]], before: int | Column,
                  after: int | None = None, bits: int | None = None) -> DataFrame:
    """:func:`box_windows` from an untiled pixel table, in one shuffle."""
    if isinstance(before, int):
        reach = max(before, before if after is None else after)
        bits = tile_bits(reach) if bits is None else bits
    elif bits is None:
        df = df.withColumn("_bits", radius_bits(before))
        return own_pixels(box_windows(halo_tiles(df, before, "_bits"), measures, before, after), "_bits").drop("_bits")
    else:
        reach = before
    return own_pixels(box_windows(halo_tiles(df, reach, bits), measures, before, after), bits)
