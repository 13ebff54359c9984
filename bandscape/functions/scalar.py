"""Column expressions: rounding, stretching, colour, thresholds.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grey weights of red, green and blue (fixed values).
GRAY_WEIGHTS = (0.299, 0.587, 0.114)

# sRGB to XYZ (D65), its inverse, and the white point (fixed values).
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.537150, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE = (0.950456, 1.0, 1.088754)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def round_u8(c: Column) -> Column:
    """Round half to even and saturate to 0..255."""
    return clamp(F.rint(c), 0.0, 255.0).cast("smallint")


def floor_u8(c: Column) -> Column:
    """Saturate to 0..255, then drop the fraction."""
    return F.floor(clamp(c.cast("double"), 0.0, 255.0)).cast("smallint")


def stretch(v: Column, lo: Column, hi: Column, bottom=0.0, top=255.0) -> Column:
    """Min-max stretch of ``v`` to ``bottom..top``; a constant input becomes ``bottom``."""
    span = (hi - lo).cast("double")
    unit = (v - lo).cast("double") / F.when(span != 0, span)
    scaled = unit * F.lit(float(top - bottom)) + F.lit(float(bottom)) if bottom else unit * F.lit(float(top))
    return F.when(v.isNotNull(), F.coalesce(scaled, F.lit(float(bottom))))


def gray(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = (F.lit(w) for w in GRAY_WEIGHTS)
    return round_u8(wr * r + wg * g + wb * b)


def rescale_10bit(v: Column) -> Column:
    """Map the low ten bits of a deep sample to 0..255, saturating above."""
    return round_u8(v * F.lit(255.0) / F.lit(1024.0))


def sigmoid(v: Column, threshold: Column, slope: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(slope)) * (threshold - v)))


def first_slot(name: Column) -> Column:
    """Lowest digit 1..8 that occurs anywhere in a file name; null if there is none."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(str(d))), F.lit(d)) for d in range(1, 9)])


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB to 8-bit CIE Lab: L scaled by 255/100, a and b shifted by 128."""

    def linear(c):
        u = c / F.lit(255.0)
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    def root(t):
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + F.lit(16.0 / 116.0))

    rgb = (linear(r), linear(g), linear(b))
    xyz = [sum((w * c for w, c in zip(row[1:], rgb[1:])), row[0] * rgb[0]) / F.lit(white)
           for row, white in zip(RGB_TO_XYZ, WHITE)]
    fx, fy, fz = (root(t) for t in xyz)
    light = F.when(xyz[1] > 0.008856, 116.0 * fy - 16.0).otherwise(903.3 * xyz[1])
    return (round_u8(light * F.lit(2.55)),
            round_u8(500.0 * (fx - fy) + 128.0),
            round_u8(200.0 * (fy - fz) + 128.0))


def lab_to_rgb(l8: Column, a8: Column, b8: Column) -> tuple[Column, Column, Column]:
    """Inverse of :func:`rgb_to_lab`, with rounding and saturation."""

    def cube(f):
        return F.when(f > F.lit(6.0 / 29.0), f * f * f).otherwise((f - F.lit(16.0 / 116.0)) / 7.787)

    def gamma(c):
        u = clamp(c, 0.0, 1.0)
        return F.when(u <= 0.0031308, 12.92 * u).otherwise(1.055 * F.pow(u, F.lit(1.0 / 2.4)) - 0.055)

    light = l8 / F.lit(2.55)
    fy = (light + 16.0) / 116.0
    fx = (a8 - F.lit(128.0)) / 500.0 + fy
    fz = fy - (b8 - F.lit(128.0)) / 200.0
    y = F.when(light > 7.9996, fy * fy * fy).otherwise(light / 903.3)
    xyz = (cube(fx) * WHITE[0], y * WHITE[1], cube(fz) * WHITE[2])
    return tuple(
        round_u8(gamma(sum((w * c for w, c in zip(row[1:], xyz[1:])), row[0] * xyz[0])) * 255.0)
        for row in XYZ_TO_RGB)
