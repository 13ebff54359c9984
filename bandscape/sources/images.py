"""Image files as pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import attach
from ..functions.scalar import first_slot, gray

_SLAB = 1 << 20     # pixels per Arrow batch handed back to Spark

_SAMPLES = ("scene_id bigint, scene string, name string, channels int, "
            "y int, x int, c0 smallint, c1 smallint, c2 smallint")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def sample_bits(data: bytes) -> int:
    """Bits per sample that an image file's header states; 8 if it states none.

    Headers read are those of PNG, TIFF and JPEG; a TIFF whose directory can't be
    read counts as 64.
    """
    if data[1:4] == b"PNG":
        return data[24] if len(data) > 24 else 8
    if data[:2] in (b"II", b"MM"):
        return _tiff_bits(data)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):     # start of frame
                return data[at + 4]
            at += 2 + int.from_bytes(data[at + 2:at + 4], "big")
    return 8


def _tiff_bits(data: bytes) -> int:
    """Largest value of tag 258 in the first directory; without the tag a sample has one bit."""
    order = "little" if data[:2] == b"II" else "big"

    def number(at: int, size: int) -> int:
        if at + size > len(data):
            raise ValueError("header beyond the end")
        return int.from_bytes(data[at:at + size], order)

    try:
        if number(2, 2) != 42:                              # other layouts are not decoded either
            return 64
        directory, bits = number(4, 4), 1
        for entry in range(directory + 2, directory + 2 + 12 * number(directory, 2), 12):
            if number(entry, 2) == 258:
                count = number(entry + 4, 4)
                start = entry + 8 if count <= 2 else number(entry + 8, 4)
                bits = max(number(start + 2 * i, 2) for i in range(count))
        return bits
    except ValueError:
        return 64


def _deep_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of image files with more than 8 bits per sample, by their headers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deep = [sample_bits(head.as_py()) > 8 for head in batch["head"]]
            yield pa.RecordBatch.from_arrays([batch["path"].filter(pa.array(deep, pa.bool_()))], ["path"])

    content = F.col("content")
    tiff = F.hex(F.substring(content, 1, 2)).isin("4949", "4D4D")      # its directory may stand anywhere
    head = F.when(tiff, content).otherwise(F.substring(content, 1, 1 << 16)).alias("head")
    return spark.read.format("binaryFile").load(path).select(_plain(F.col("path")).alias("path"), head).mapInArrow(work, "path string")


def _images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files of deeper samples than 8 bits, whatever their format,
    are dropped since the decoder would keep only the low byte of each sample
    without saying so."""
    decoded = (spark.read.format("image").load(path).select("image.*")
               .withColumn("path", _plain(F.col("origin"))))
    part = F.split("path", "/")
    return (attach(decoded, _deep_files(spark, path), ["path"], "left_anti")
            .withColumn("name", F.element_at(part, -1))
            .withColumn("scene", F.coalesce(F.try_element_at(part, F.lit(-2)), F.lit("")))
            .withColumn("scene_id", F.xxhash64(F.regexp_replace("path", "/[^/]*$", ""))))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File list for the catalogues: scene, name and size (null if not decodable)."""
    size = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("height", "width")}
    return _images(spark, path).withColumns(size).select("scene_id", "scene", "name", "height", "width")


def _unroll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for image in batch.itertuples(index=False):
            grid = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.nChannels)
            step = max(1, _SLAB // image.width)
            for top in range(0, image.height, step):
                part = grid[top:top + step]
                y, x = np.indices(part.shape[:2], np.int32)
                samples = {f"c{i}": (part[:, :, i].ravel().astype(np.int16) if i < image.nChannels
                                     else pd.array([pd.NA] * y.size, dtype="Int16")) for i in range(3)}
                yield pd.DataFrame({
                    "scene_id": image.scene_id, "scene": image.scene, "name": image.name_,
                    "channels": np.int32(image.nChannels),
                    "y": y.ravel() + np.int32(top), "x": x.ravel(), **samples})


def image_samples(images: DataFrame) -> DataFrame:
    """One row per pixel of decoded images (Spark's image columns plus scene_id,
    scene and name); colour samples come in the order blue, green, red."""
    usable = images.filter(F.col("height") > 0)
    return usable.select("scene_id", "scene", F.col("name").alias("name_"), "height", "width", "nChannels",
                         "data").mapInPandas(_unroll, _SAMPLES)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per pixel of every decodable image below ``path``."""
    return image_samples(_images(spark, path))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixel table of the band images below ``path``."""
    return grey_pixels(read_samples(spark, path))


def grey_pixels(samples: DataFrame) -> DataFrame:
    """Samples to one value per pixel: the band is the slot in the file name, and
    colour images are turned into grey."""
    value = F.when(F.col("channels") == 1, F.col("c0")).otherwise(
        gray(F.col("c2"), F.col("c1"), F.col("c0")))
    return samples.select(
        "scene_id", "scene", "name",        first_slot(F.col("name")).cast("int").alias("band"), "y", "x",
        value.cast("smallint").alias("value"))


def band_pixels(samples: DataFrame, bands: DataFrame) -> DataFrame:
    """Pixel table of the listed bands (scene_id, name, band), as the catalogues
    give them; other images are dropped."""
    values = grey_pixels(samples).drop("band")
    return attach(values, bands.select("scene_id", "name", "band"), ["scene_id", "name"], "inner").select(
        "scene_id", "band", "y", "x", "value")


def mask_pixels(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mask table of the images that an open-band catalogue lists as masks."""
    masks = catalog.filter("role = 'mask'").select("scene_id", "name")
    return attach(grey_pixels(samples), masks, ["scene_id", "name"], "inner").select(
        "scene_id", "y", "x", F.col("value").alias("label"))


def split_channels(samples: DataFrame) -> DataFrame:
    """Colour samples to one band per channel (1 blue, 2 green, 3 red); missing
    channels give no rows."""
    bands = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(f"c{i}").cast("smallint").alias("value"))
                      for i in range(3)])
    keep = [c for c in samples.columns if c not in ("channels", "c0", "c1", "c2")]
    return (samples.select(*keep, F.inline(bands)).filter("value IS NOT NULL")
            .select(*[c for c in keep if c not in ("y", "x")], "band", "y", "x", "value"))
