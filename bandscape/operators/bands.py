"""Band normalisation, reshaping and per-pixel projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.joins import attach
from ..schema import FOREGROUND, PIXEL, band_columns


def to_gray(df: DataFrame, r="r", g="g", b="b", out="gray") -> DataFrame:
    return df.withColumn(out, S.gray(F.col(r), F.col(g), F.col(b)))


def rescale_depth(df: DataFrame, value="value", out="value") -> DataFrame:
    """Deep samples to 8 bit, keeping the low ten bits."""
    return df.withColumn(out, S.rescale_10bit(F.col(value)))


def minmax(df: DataFrame, keys=("scene_id", "band"), value="value", lo=0.0, hi=255.0,
           rounded=True, out=None) -> DataFrame:
    """Stretch ``value`` to ``lo..hi`` within each key."""
    return minmax_columns(df, list(keys), {out or value: F.col(value)}, lo, hi, rounded)


def minmax_columns(df: DataFrame, keys: list[str], columns: dict[str, Column],
                   lo=0.0, hi=255.0, rounded=True) -> DataFrame:
    """Stretch several expressions with one aggregation pass."""
    bounds = [f(c).alias(f"_{side}_{name}") for name, c in columns.items()
              for side, f in (("lo", F.min), ("hi", F.max))]
    ranges = df.groupBy(*keys).agg(*bounds)
    done = {}
    for name, c in columns.items():
        v = S.stretch(c, F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), lo, hi)
        done[name] = S.round_u8(v) if rounded else v
    helpers = [f"_{side}_{name}" for name in columns for side in ("lo", "hi")]
    return attach(df, ranges, keys).withColumns(done).drop(*helpers)


def normalise_bands(pixels: DataFrame, deep: bool = False) -> DataFrame:
    """Loader normalisation: 8-bit bands are stretched, deep ones are rescaled.

    A column ``depth`` (bits per sample) decides image by image; without it ``deep``
    holds for all.
    """
    if "depth" in pixels.columns:
        flat = minmax(pixels, out="_flat")
        value = F.when(F.col("depth") > 8, S.rescale_10bit(F.col("value"))).otherwise(F.col("_flat"))
        return flat.withColumn("value", value.cast("smallint")).drop("_flat", "depth")
    return rescale_depth(pixels) if deep else minmax(pixels)


def vis_band(pixels: DataFrame) -> DataFrame:
    """The visible band: the second one."""
    return pixels.filter(F.col("band") == 2)


def bg_band(pixels: DataFrame) -> DataFrame:
    """The background band: the last one of each scene."""
    last = pixels.groupBy("scene_id").agg(F.max("band").alias("_last"))
    return attach(pixels, last, ["scene_id"]).filter(F.col("band") == F.col("_last")).drop("_last")


def to_signal(pixels: DataFrame, bands: int | list[int] = 8) -> DataFrame:
    """Band rows to one row per pixel with columns ``b1 … bC``.

    The band list is given, so no extra pass looks for it, and one hash
    aggregation on the pixel key does the work.
    """
    numbers = range(1, bands + 1) if isinstance(bands, int) else bands
    return pixels.groupBy(*PIXEL).agg(
        *[F.max(F.when(F.col("band") == k, F.col("value"))).alias(f"b{k}") for k in numbers])


def to_pixels(signal: DataFrame) -> DataFrame:
    """Signal rows back to band rows; absent bands give no rows."""
    cells = F.array(*[F.struct(F.lit(int(c[1:])).alias("band"), F.col(c).alias("value"))
                      for c in band_columns(signal)])
    return (signal.select(*PIXEL, F.inline(cells)).filter("value IS NOT NULL")
            .select("scene_id", "band", "y", "x", "value"))


def complete_scenes(signal: DataFrame) -> DataFrame:
    """Pixels that have all bands."""
    return signal.dropna(subset=band_columns(signal))


def remove_background(signal: DataFrame, vis: str | None = None, bg: str | None = None,
                      out: str = "value") -> DataFrame:
    """Visible minus background band, stretched per scene.

    If the two bands of a scene differ in size, the visible band is kept as it is.
    """
    bands = band_columns(signal)
    v, b = F.col(vis or "b2"), F.col(bg or bands[-1])
    diff = v.cast("int") - b.cast("int")
    has_v, has_b = v.isNotNull(), b.isNotNull()
    corner = lambda present, c: F.max(F.when(present, F.col(c)))
    facts = signal.groupBy("scene_id").agg(
        F.min(diff).alias("_lo"), F.max(diff).alias("_hi"),
        (corner(has_v, "y").eqNullSafe(corner(has_b, "y"))
         & corner(has_v, "x").eqNullSafe(corner(has_b, "x"))).alias("_same"))
    cleaned = S.round_u8(S.stretch(diff, F.col("_lo"), F.col("_hi")))
    return (attach(signal, facts, ["scene_id"])
            .withColumn(out, F.when(F.col("_same"), cleaned).otherwise(v).cast("smallint"))
            .drop("_lo", "_hi", "_same"))


def invert(df: DataFrame, value="label") -> DataFrame:
    return df.withColumn(value, (F.lit(255) - F.col(value)).cast("smallint"))


def binarise(df: DataFrame, value="label") -> DataFrame:
    """255 where the value is positive, else 0."""
    return df.withColumn(value, F.when(F.col(value) > 0, 255).otherwise(0).cast("smallint"))


def to_unit(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(255.0) for c in columns})


def with_mask(signal: DataFrame, mask: DataFrame) -> DataFrame:
    """Signal and mask label in one row."""
    return signal.join(mask.select(*PIXEL, "label"), PIXEL)


def foreground(signal: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Signal rows under the mask; the label may already be a column."""
    if mask is not None:
        return signal.join(mask.filter(F.col("label") > 0).select(*PIXEL), PIXEL, "left_semi")
    return signal.filter(F.col("label") > 0)


def _moments(signal: DataFrame) -> tuple[Column, Column]:
    bands = [F.col(c).cast("double") for c in band_columns(signal)]
    n = F.lit(float(len(bands)))
    mean = reduce(lambda a, b: a + b, bands) / n
    square = reduce(lambda a, b: a + b, [c * c for c in bands]) / n
    std = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return mean, std


def _features(signal: DataFrame) -> dict[str, Column]:
    mean, std = _moments(signal)
    return {"mean": S.floor_u8(mean.cast("float")), "std": S.floor_u8(std.cast("float"))}


def spectral_mean_std(signal: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the bands of each pixel, as
    8-bit values, each stretched per scene."""
    keep = list(signal.columns)
    raw = signal.withColumns(_features(signal))
    return minmax_columns(raw, ["scene_id"], {"mean": F.col("mean"), "std": F.col("std")}).select(
        *keep, "mean", "std")


def feature_composite(signal: DataFrame) -> DataFrame:
    """Add the three features ``c0`` (cleaned visible band), ``c1`` (mean) and
    ``c2`` (standard deviation), from one statistics pass over the signal."""
    bands = band_columns(signal)
    raw = signal.withColumns({"c0": F.col("b2").cast("int") - F.col(bands[-1]).cast("int"),
                              **dict(zip(("c1", "c2"), _features(signal).values()))})
    return minmax_columns(raw, ["scene_id"], {c: F.col(c) for c in ("c0", "c1", "c2")})


# Thresholds (sure foreground, probable foreground, probable background, sure
# background) for coherence scores and for forest scores (fixed values).
TRIMAP_PRESETS = {"score": (0.3, 0.1, 0.0, 0.0), "forest": (0.95, 0.8, 0.4, 0.1)}


def trimap_label(score: Column, label: Column, preset="score") -> Column:
    fgd, pr_fgd, pr_bgd, bgd = TRIMAP_PRESETS[preset] if isinstance(preset, str) else preset
    return (F.when((score > fgd) & (label == FOREGROUND), "FGD")
             .when((score <= bgd) & (label == 0), "BGD")
             .when(score > pr_fgd, "PR_FGD")
             .when(score <= pr_bgd, "PR_BGD")
             .when(label == 0, "BGD")
             .otherwise("PR_FGD"))


def trimap(scores: DataFrame, mask: DataFrame | None = None, preset="score") -> DataFrame:
    """Sure and probable foreground or background from score and mask."""
    both = scores if mask is None else scores.join(mask.select(*PIXEL, "label"), PIXEL)
    return both.withColumn("trimap", trimap_label(F.col("score"), F.col("label"), preset))


def trimap_to_mask(df: DataFrame, trimap="trimap") -> DataFrame:
    return df.withColumn("label", F.when(F.col(trimap).isin("FGD", "PR_FGD"), 255).otherwise(0).cast("smallint"))


def pseudo_color(features: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """False-colour view: blend the score into the a-channel of the composite."""
    df = features if scores is None else features.join(scores.select(*PIXEL, "score"), PIXEL)
    lab = dict(zip(("_l", "_a", "_b"), S.rgb_to_lab(F.col("c0"), F.col("c1"), F.col("c2"))))
    blend = S.round_u8(F.col("_a") * 0.5 + S.round_u8(F.col("score") * 255.0) * 0.5)
    rgb = dict(zip(("r", "g", "b"), S.lab_to_rgb(F.col("_l"), F.col("_a"), F.col("_b"))))
    return (df.withColumns(lab).withColumn("_a", blend).withColumns(rgb).drop("_l", "_a", "_b"))


def zero_scores(scores: DataFrame, violations: DataFrame) -> DataFrame:
    """Score 0 at every pixel of ``violations``."""
    marks = violations.select(*PIXEL).distinct().withColumn("_hit", F.lit(True))
    return (scores.join(marks, PIXEL, "left")
            .withColumn("score", F.when(F.col("_hit"), 0.0).otherwise(F.col("score"))).drop("_hit"))


def sigmoid_weight(df: DataFrame, slope: float = 15.0, value="gray", threshold="threshold",
                   out="weight") -> DataFrame:
    """Weight of a unit grey value against its threshold: dark pixels near 1."""
    return df.withColumn(out, S.sigmoid(F.col(value), F.col(threshold), slope))


def enhance_saturation(df: DataFrame, sensitivity: float = 0.5, r="r", g="g", b="b", out="gray") -> DataFrame:
    """Grey value darkened by saturation: 0 keeps the grey value, 1 is the
    inverted saturation alone."""
    red, green, blue = (F.col(c).cast("double") for c in (r, g, b))
    saturation = F.greatest(red, green, blue) - F.least(red, green, blue)
    grey = S.GRAY_WEIGHTS[0] * red + S.GRAY_WEIGHTS[1] * green + S.GRAY_WEIGHTS[2] * blue
    s = float(sensitivity)
    return df.withColumn(out, S.round_u8((1.0 - s) * grey + s * (255.0 - saturation)))
