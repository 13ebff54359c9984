"""Result tables: inverted masks and rotated score maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach


def inverted(df: DataFrame, value: str = "label") -> DataFrame:
    return df.withColumn(value, (F.lit(255) - F.col(value)).cast("smallint"))


def write_mask(df: DataFrame, path: str) -> None:
    """Write the inverted mask (ink black), one folder per scene.

    Rows are split by ranges of (scene, y): a scene stays in few files and a
    large one is still written by many tasks.
    """
    (inverted(df).repartitionByRange("scene_id", "y")
     .write.mode("overwrite").partitionBy("scene_id").parquet(path))


def rotate_quarter(df: DataFrame, turns: int = 1, grid: DataFrame | None = None) -> DataFrame:
    """Rotate each scene counter-clockwise by ``turns`` quarter turns.

    The scene sizes come from ``grid``, a table that is cheap to read and has
    every pixel, or from ``df`` itself.
    """
    turns %= 4
    if turns == 0:
        return df
    sizes = (df if grid is None else grid).groupBy("scene_id").agg(
        (F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    y, x, h, w = (F.col(c) for c in ("y", "x", "_h", "_w"))
    target = {1: (w - 1 - x, y), 2: (h - 1 - y, w - 1 - x), 3: (x, h - 1 - y)}[turns]
    return (attach(df, sizes, ["scene_id"])
            .withColumns({"y": target[0].cast("int"), "x": target[1].cast("int")}).drop("_h", "_w"))
