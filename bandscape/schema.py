"""Column names and explicit schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

PIXEL = ["scene_id", "y", "x"]

# Labels of a mask image (fixed values).
FOREGROUND, OUTLIER, BACKGROUND = 255, 100, 0

FILES = T.StructType([
    T.StructField("scene_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("height", T.IntegerType(), True),   # null: not decodable
    T.StructField("width", T.IntegerType(), True),
])

PIXELS = T.StructType([
    T.StructField("scene_id", T.LongType(), False),
    T.StructField("band", T.IntegerType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("value", T.ShortType(), True),
])

MASK = T.StructType([
    T.StructField("scene_id", T.LongType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("label", T.ShortType(), False),
])

SEGMENTS = T.StructType([
    T.StructField("scene_id", T.LongType(), False),
    T.StructField("seg_id", T.LongType(), False),
    T.StructField("x0", T.DoubleType(), False),
    T.StructField("y0", T.DoubleType(), False),
    T.StructField("x1", T.DoubleType(), False),
    T.StructField("y1", T.DoubleType(), False),
])


def band_columns(df) -> list[str]:
    """Band columns ``b1 … bC`` of a signal table, in band order."""
    found = [c for c in df.columns if c[:1] == "b" and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))
