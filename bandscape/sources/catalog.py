"""Which files of a scene folder are bands, and is the scene complete?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach, ranked
from ..functions.scalar import first_slot

BANDS = 8


def scene_catalog(files: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``slot`` (1..8 or null) and ``role`` (band, gt, ignored) to a file list.

    In strict mode a name without ``F`` is ignored.  A decodable file is a band
    if it has a slot and its name lacks ``GT``; any other decodable file is
    ground truth, of which the last name of a scene counts.
    """
    named = F.contains("name", F.lit("F")) if strict else F.lit(True)
    usable = named & F.col("height").isNotNull() & F.col("width").isNotNull()
    slot = first_slot(F.col("name"))
    is_band = usable & slot.isNotNull() & ~F.contains("name", F.lit("GT"))
    tagged = files.withColumns({"slot": slot, "_band": is_band, "_truth": usable & ~is_band})
    last = tagged.groupBy("scene_id").agg(F.max(F.when(F.col("_truth"), F.col("name"))).alias("_last"))
    role = (F.when(F.col("_band"), "band")
             .when(F.col("_truth") & (F.col("name") == F.col("_last")), "gt")
             .otherwise("ignored"))
    return attach(tagged, last, ["scene_id"]).withColumn("role", role).drop("_band", "_truth", "_last")


def _reference_size(bands: DataFrame) -> DataFrame:
    """Size of the first accepted file of each scene."""
    size = F.min_by(F.struct("height", "width"), F.when(F.col("role") == "band", F.col("name")))
    return (bands.groupBy("scene_id").agg(size.alias("_size"))
                 .select("scene_id", F.col("_size.height").alias("ref_height"),
                         F.col("_size.width").alias("ref_width")))


def validate_scenes(catalog: DataFrame, bands: int = BANDS, max_entries: int | None = None) -> DataFrame:
    """One row per scene: reference size, accepted bands and a status code.

    Status: ``too_many_files``, ``duplicate_slot``, ``empty_slot`` or ``valid``.
    Bands of another size than the first one are dropped before slots are checked.
    """
    fits = ((F.col("role") == "band") & (F.col("height") == F.col("ref_height"))
            & (F.col("width") == F.col("ref_width")))
    slot = F.when(fits, F.col("slot"))
    scenes = (attach(catalog, _reference_size(catalog), ["scene_id"])
              .groupBy("scene_id", "ref_height", "ref_width", slot.alias("_slot"))
              .agg(F.count("*").alias("_files"))
              .groupBy("scene_id", F.col("ref_height").alias("height"), F.col("ref_width").alias("width"))
              .agg(F.sum("_files").alias("entries"),
                   F.coalesce(F.sum(F.when(F.col("_slot").isNotNull(), F.col("_files"))), F.lit(0)).alias("accepted"),
                   F.count("_slot").alias("slots")))
    status = F.when(F.col("accepted") > F.col("slots"), "duplicate_slot")
    if max_entries is not None:
        status = F.when(F.col("entries") > max_entries, "too_many_files").when(
            F.col("accepted") > F.col("slots"), "duplicate_slot")
    status = status.when(F.col("slots") < bands, "empty_slot").otherwise("valid")
    return scenes.withColumn("status", status)


def accepted_bands(catalog: DataFrame, scenes: DataFrame) -> DataFrame:
    """Band files of the valid scenes, as (scene_id, name, band)."""
    good = scenes.filter("status = 'valid'").select("scene_id", F.col("height").alias("ref_height"),
                                                     F.col("width").alias("ref_width"))
    fits = (F.col("height") == F.col("ref_height")) & (F.col("width") == F.col("ref_width"))
    return (attach(catalog.filter("role = 'band'"), good, ["scene_id"], "inner")
            .filter(fits).select("scene_id", "name", F.col("slot").cast("int").alias("band")))


def open_catalog(files: DataFrame) -> DataFrame:
    """Catalogue with any number of bands: role mask, band, resized or ignored.

    A name containing ``mask`` is the mask; the last one counts.  Every other
    decodable file is a band; those of another size than the scene's first band
    are removed.  The rest is numbered in name order.
    """
    decodable = F.col("height").isNotNull() & F.col("width").isNotNull()
    is_mask = decodable & F.contains("name", F.lit("mask"))
    is_band = decodable & ~F.contains("name", F.lit("mask"))
    size = F.struct("height", "width")
    first = files.groupBy("scene_id").agg(
        F.min_by(size, F.when(is_band, F.col("name"))).alias("_size"),
        F.max(F.when(is_mask, F.col("name"))).alias("_mask"))
    role = (F.when(is_mask & (F.col("name") == F.col("_mask")), "mask")
             .when(is_band & (size == F.col("_size")), "band")
             .when(is_band, "resized")
             .otherwise("ignored"))
    listed = attach(files, first, ["scene_id"]).withColumn("role", role).drop("_size", "_mask")
    numbered = ranked(listed, ["scene_id", "role"], ["name"], "band")
    return numbered.withColumn("band", F.when(F.col("role") == "band", F.col("band"))).select(*files.columns, "role", "band")
