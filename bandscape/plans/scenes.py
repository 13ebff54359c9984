"""From bands to masks, score maps and colour views, for all scenes at once.

Intermediate pixel tables that several steps read are kept with ``materialise``; call
``bandscape.functions.runtime.release`` when the result is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import attach
from ..functions.runtime import materialise
from ..operators import bands as B
from ..operators.blobs import clean_blobs
from ..operators.neighborhood import binarise_local
from ..operators.score import ace_score
from ..operators.segment import refine
from ..operators.stats import flag_outliers
from ..schema import PIXEL, band_columns
from ..sources.sinks import rotate_quarter

# Blobs up to this area are noise (fixed value).
MIN_BLOB = 20


def complete_scenes(pixels: DataFrame, bands: int = 8) -> DataFrame:
    """Pixels of scenes that have all bands, all of one size."""
    sizes = pixels.groupBy("scene_id", "band").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    facts = sizes.groupBy("scene_id").agg(
        F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"),
        F.min("w").alias("w0"), F.max("w").alias("w1"))
    good = facts.filter((F.col("n") == bands) & (F.col("h0") == F.col("h1")) & (F.col("w0") == F.col("w1")))
    return attach(pixels, good.select("scene_id"), ["scene_id"], "inner")


def rough_masks(grey: DataFrame, min_area: int = MIN_BLOB, stroke: int | None = None) -> DataFrame:
    """Local binarisation as ``label`` without blobs of up to ``min_area`` pixels,
    and as ``base`` without isolated blobs.  Bands of ``grey`` stay beside them."""
    return clean_blobs(materialise(binarise_local(grey, stroke=stroke).drop("value", "contrast")), min_area)


def score_scene(masked: DataFrame) -> DataFrame:
    """Signal with masks and the coherence score of the spectrally consistent foreground."""
    return ace_score(flag_outliers(materialise(masked.dropna(subset=PIXEL))))


def _binarize(grey: DataFrame, min_area: int, **refinement) -> DataFrame:
    scored = score_scene(rough_masks(grey, min_area)).select(*PIXEL, *band_columns(grey), "base", "score")
    features = B.feature_composite(scored).select(*PIXEL, "c0", "c1", "c2", "score", "base")
    return refine(features, **refinement).select(*PIXEL, "label")


def _cleaned(signal: DataFrame) -> DataFrame:
    return materialise(B.remove_background(signal))


def binarize_msi(pixels: DataFrame, bands: int = 8, min_area: int = MIN_BLOB, **refinement) -> DataFrame:
    """Foreground mask of multispectral scenes; incomplete scenes give no rows."""
    signal = materialise(B.to_signal(B.normalise_bands(complete_scenes(pixels, bands)), bands))
    return _binarize(_cleaned(signal), min_area, **refinement)


def binarize_rgb(pixels: DataFrame, min_area: int = MIN_BLOB, **refinement) -> DataFrame:
    """Foreground mask of colour scenes (three bands): the second band is
    thresholded as it is."""
    signal = materialise(B.complete_scenes(B.to_signal(B.normalise_bands(pixels), 3)))
    return _binarize(signal.withColumn("value", F.col("b2")), min_area, **refinement)


def ace_map(pixels: DataFrame, mask: DataFrame, deep: bool = False, turns: int = 1) -> DataFrame:
    """Rotated score map of scenes with any number of bands under a given mask;
    scenes without a mask are skipped."""
    present = attach(pixels, mask.select("scene_id").distinct(), ["scene_id"], "inner")
    normalised = B.normalise_bands(present, deep)
    counts = materialise(present.groupBy("scene_id").agg(F.max("band").alias("_bands")))
    # One plan per distinct number of bands: a handful of values.
    widths = sorted(r[0] for r in counts.select("_bands").distinct().collect())
    parts = []
    for width in widths:
        some = attach(normalised, counts.filter(F.col("_bands") == width).select("scene_id"), ["scene_id"], "inner")
        table = materialise(B.with_mask(B.to_signal(some, width), mask))
        parts.append(rotate_quarter(ace_score(table).select(*PIXEL, "score"), turns, grid=table))
    return reduce(DataFrame.unionByName, parts) if parts else present.selectExpr(*PIXEL, "double(value) AS score")


def visualize_msi(pixels: DataFrame, bands: int = 8, min_area: int = MIN_BLOB) -> DataFrame:
    """False-colour view: features with the score blended into the a-channel."""
    signal = materialise(B.to_signal(B.normalise_bands(complete_scenes(pixels, bands)), bands))
    scored = score_scene(rough_masks(_cleaned(signal), min_area))
    features = B.feature_composite(scored.select(*PIXEL, *band_columns(signal), "score"))
    shown = features.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return B.pseudo_color(shown).select(*PIXEL, "r", "g", "b")
