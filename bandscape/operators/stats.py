"""Per-scene and per-band statistics.

All aggregate with map-side partial aggregation: what is shuffled is one small
buffer per group and map task, however many pixels a scene has.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import FOREGROUND, OUTLIER, PIXEL, band_columns
from .bands import with_mask

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)


def _unpivot(df: DataFrame, *keep: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(int(c[1:])).alias("band"), F.col(c).alias("value"))
                      for c in band_columns(df)])
    return df.select(*keep, F.inline(cells))


def target_signature(signal: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Mean of each band over pixels labelled exactly 255, on the unit scale."""
    table = signal if mask is None else with_mask(signal, mask)
    bands = band_columns(table)
    means = (table.filter(F.col("label") == FOREGROUND).groupBy("scene_id")
             .agg(*[F.avg(c).alias(c) for c in bands]))
    return _unpivot(means, "scene_id").select("scene_id", "band", (F.col("value") / 255.0).alias("signature"))


def band_means(signal: DataFrame) -> DataFrame:
    bands = band_columns(signal)
    return signal.groupBy("scene_id").agg(*[F.avg(c).alias(f"m{c[1:]}") for c in bands])


def center(signal: DataFrame) -> DataFrame:
    """Subtract each scene's band means."""
    bands = band_columns(signal)
    means = band_means(signal)
    return (attach(signal, means, ["scene_id"])
            .withColumns({c: F.col(c) - F.col(f"m{c[1:]}") for c in bands})
            .drop(*[f"m{c[1:]}" for c in bands]))


def band_pairs(bands: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(bands, 2))


def scene_moments(table: DataFrame, labelled: bool = False) -> DataFrame:
    """One row per scene: pixel count ``n``, band means ``m*``, sample
    covariances ``c_i_j`` (i ≤ j) and, if labelled, foreground means ``t*``.

    One pass gives everything the coherence score needs.  Integer samples are
    summed as integers, so the result does not depend on the order of rows.
    """
    bands = band_columns(table)
    pairs = band_pairs(bands)
    whole = all(isinstance(table.schema[c].dataType, _WHOLE) for c in bands)
    aggs = {"n": "count(*)"}
    if whole:
        aggs |= {f"s_{c}": f"sum(bigint({c}))" for c in bands}
        aggs |= {f"p_{a}_{b}": f"sum(bigint({a}) * bigint({b}))" for a, b in pairs}
    else:
        aggs |= {f"m{c[1:]}": f"avg({c})" for c in bands}
        aggs |= {f"c_{a[1:]}_{b[1:]}": f"covar_samp({a}, {b})" for a, b in pairs}
    if labelled:
        aggs["n_target"] = f"count_if(label = {FOREGROUND})"
        aggs |= {f"t{c[1:]}": f"avg(CASE WHEN label = {FOREGROUND} THEN {c} END)" for c in bands}
    sums = table.groupBy("scene_id").agg(*[F.expr(v).alias(k) for k, v in aggs.items()])
    if not whole:
        return sums
    kept = [c for c in sums.columns if c[:2] not in ("s_", "p_")]
    return sums.selectExpr(
        *kept, *[f"s_{c} / double(n) AS m{c[1:]}" for c in bands],
        *[f"(p_{a}_{b} - double(s_{a}) * double(s_{b}) / double(n)) / CASE WHEN n > 1 THEN double(n - 1) END"
          f" AS c_{a[1:]}_{b[1:]}" for a, b in pairs])


def covariance(signal: DataFrame) -> DataFrame:
    """Sample covariance matrix per scene in long form (i ≤ j)."""
    bands = band_columns(signal)
    cells = F.array(*[F.struct(F.lit(int(a[1:])).alias("i"), F.lit(int(b[1:])).alias("j"),
                               F.col(f"c_{a[1:]}_{b[1:]}").alias("cov")) for a, b in band_pairs(bands)])
    return scene_moments(signal).select("scene_id", F.inline(cells))


def iqr_bounds(signal: DataFrame, mask: DataFrame | None = None, w: float = 1.5) -> DataFrame:
    """Quartiles of each band over the foreground and the fence ``w`` quartile
    ranges outside of them, as 8-bit bounds.

    Values are counted first (at most 256 per band), so exact quartiles come
    from a small histogram instead of from all pixels.
    """
    table = signal if mask is None else with_mask(signal, mask)
    counted = (_unpivot(table.filter(F.col("label") > 0), "scene_id")
               .groupBy("scene_id", "band", "value").agg(F.count("*").alias("_n")))
    q = (counted.filter("value IS NOT NULL").groupBy("scene_id", "band")
         .agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("_q"))
         .select("scene_id", "band", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q75")))
    reach = F.lit(float(w)) * (F.col("q75") - F.col("q25"))
    return q.withColumns({"lower": S.floor_u8(F.col("q25") - reach), "upper": S.floor_u8(F.col("q75") + reach)})


def flag_outliers(signal: DataFrame, mask: DataFrame | None = None, w: float = 1.5) -> DataFrame:
    """Label a foreground pixel 100 if any band leaves that band's quartile fence."""
    table = signal if mask is None else materialise(with_mask(signal, mask))      # read twice
    bands = band_columns(table)
    limits = iqr_bounds(table, w=w)
    row = limits.groupBy("scene_id").agg(
        *[F.max(F.when(F.col("band") == int(c[1:]), F.col(side))).alias(f"_{side}_{c}")
          for c in bands for side in ("lower", "upper")])
    out = F.lit(False)
    for c in bands:
        out = out | (F.col(c) < F.col(f"_lower_{c}")) | (F.col(c) > F.col(f"_upper_{c}"))
    return (attach(table, row, ["scene_id"])
            .withColumn("label", F.when((F.col("label") > 0) & out, OUTLIER)
                        .otherwise(F.col("label")).cast("smallint"))
            .select(*table.columns))


def histogram(df: DataFrame, value: str = "value") -> DataFrame:
    """Counts of the grey values per scene, empty bins included: bins 0 to 255,
    and on to the smallest and largest value of deep samples.  Null samples are
    not counted; a scene of null samples alone has empty bins."""
    bins = df.groupBy("scene_id", F.col(value).cast("int").alias("bin")).agg(F.count(value).alias("n"))
    # One entry per distinct value of a scene.
    by_scene = bins.groupBy("scene_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("_m"),
        F.least(F.lit(0), F.min("bin")).alias("_low"), F.greatest(F.lit(255), F.max("bin")).alias("_high"))
    return (by_scene.select("scene_id", "_m", F.explode(F.sequence("_low", "_high")).alias("bin"))
            .select("scene_id", "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n")))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold with the largest between-class variance; the first one wins.

    The windows run over the 256 bins of a scene's histogram.
    """
    upto = Window.partitionBy("scene_id").orderBy("bin")
    whole = Window.partitionBy("scene_id")
    n = F.col("n").cast("double")
    weight = n * F.col("bin")
    sums = hist.withColumns({"n0": F.sum(n).over(upto), "s0": F.sum(weight).over(upto),
                             "n": F.sum(n).over(whole), "s": F.sum(weight).over(whole)})
    gap = F.col("s0") * F.col("n") - F.col("s") * F.col("n0")
    between = gap * gap / F.when((F.col("n0") > 0) & (F.col("n0") < F.col("n")),
                                 F.col("n0") * (F.col("n") - F.col("n0")))
    scored = sums.withColumn("between", F.coalesce(between, F.lit(0.0)))
    best = F.max_by("bin", F.struct("between", (-F.col("bin")).alias("first")))
    return scored.groupBy("scene_id").agg(best.alias("threshold"))


def profile(pixels: DataFrame) -> DataFrame:
    """Rows, columns and dynamic range of every band image."""
    return pixels.groupBy("scene_id", "band").agg(
        (F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))


def pca_angle(points: DataFrame, keys: list[str], x="x", y="y") -> DataFrame:
    """Direction of the first principal axis, modulo pi."""
    spread = points.groupBy(*keys).agg(
        F.var_samp(x).alias("cxx"), F.var_samp(y).alias("cyy"), F.covar_samp(x, y).alias("cxy"))
    angle = 0.5 * F.atan2(2.0 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    return spread.select(*keys, angle.alias("angle"))


def bounding_box(points: DataFrame, keys: list[str], x="x", y="y") -> DataFrame:
    return points.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"),
                                     F.max(x).alias("x1"), F.max(y).alias("y1"))


# Expected share of text on a fully described page (fixed value).
TEXT_SHARE = 0.2


def confidence(df: DataFrame, contrast="contrast", label="label") -> DataFrame:
    """Mean contrast per scene and how far a segmentation can be trusted: the
    closer the foreground share is to that of a written page, the better,
    weighted with the mean contrast of the foreground."""
    ink = F.col(label) > 0
    facts = df.groupBy("scene_id").agg(
        F.avg(contrast).alias("mean_contrast"),
        F.coalesce(F.avg(F.when(ink, F.col(contrast))), F.lit(0.0)).alias("ink_contrast"),
        (F.count_if(ink) / F.count("*")).alias("share"))
    close = F.greatest(1.0 - F.abs(F.col("share") - TEXT_SHARE) / TEXT_SHARE, F.lit(0.0))
    return facts.withColumn("confidence", close * F.col("ink_contrast"))


def overlap_share(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the positive pixels of ``b`` that are positive in ``a``."""
    both = a.select(*PIXEL, F.col("label").alias("_a")).join(
        b.select(*PIXEL, F.col("label").alias("_b")), PIXEL, "right")
    hits = F.count_if((F.col("_a") > 0) & (F.col("_b") > 0))
    base = F.count_if(F.col("_b") > 0)
    return both.groupBy("scene_id").agg(
        hits.alias("overlap"), base.alias("positive"),
        (hits / F.when(base > 0, base)).alias("share"))
