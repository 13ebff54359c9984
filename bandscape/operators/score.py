"""Target scoring: adaptive coherence and random forest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL, band_columns
from .bands import minmax_columns, with_mask
from .masks import balanced_sample
from .stats import band_pairs, scene_moments

# Singular values below this share of the largest count as zero (fixed value).
RANK_TOLERANCE = 1e-12


def coherence_model(table: DataFrame) -> DataFrame:
    """One row per scene: band means, ``u = Σ⁻¹s``, ``t = sᵀΣ⁻¹s`` and the upper
    triangle of ``Σ⁻¹`` (off-diagonal terms doubled), plus a status.

    The pseudo-inverse runs on batches of per-scene rows, never on pixels.
    """
    bands = band_columns(table)
    ids = [c[1:] for c in bands]
    pairs = [(int(i), int(j)) for i, j in np.transpose(np.triu_indices(len(bands)))]
    names = [f"c_{a[1:]}_{b[1:]}" for a, b in band_pairs(bands)]
    moments = scene_moments(table, labelled=True)
    rows, cols = (np.array(k) for k in zip(*pairs))
    doubled = np.where(rows == cols, 1.0, 2.0)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cov = np.zeros((len(batch), len(ids), len(ids)))
            cov[:, rows, cols] = cov[:, cols, rows] = batch[names].to_numpy(float, na_value=np.nan)
            mean = batch[[f"m{i}" for i in ids]].to_numpy(float, na_value=np.nan)
            target = batch[[f"t{i}" for i in ids]].to_numpy(float, na_value=np.nan) - mean
            known = np.isfinite(cov).all((1, 2)) & np.isfinite(target).all(1)
            inverse = np.linalg.pinv(np.where(known[:, None, None], cov, 0.0), rcond=RANK_TOLERANCE, hermitian=True)
            u = np.einsum("nij,nj->ni", inverse, np.where(known[:, None], target, 0.0))
            t = np.einsum("ni,ni->n", u, np.where(known[:, None], target, 0.0))
            status = np.where(batch["n"] < 2, "too_few_pixels",
                              np.where(batch["n_target"] == 0, "no_target", np.where(known, "ok", "missing_band")))
            yield pd.DataFrame({
                "scene_id": batch["scene_id"], "status": status,
                "_mean": [m if k else None for m, k in zip(mean, known)],
                "_u": [v if k else None for v, k in zip(u, known)],
                "_t": pd.array(np.where(known, t, np.nan), dtype="Float64"),
                "_w": [w if k else None for w, k in zip(inverse[:, rows, cols] * doubled, known)]})

    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([table.schema["scene_id"], T.StructField("status", T.StringType()),
                           T.StructField("_mean", array), T.StructField("_u", array),
                           T.StructField("_t", T.DoubleType()), T.StructField("_w", array)])
    return moments.mapInPandas(invert, schema)


def ace_raw(table: DataFrame) -> DataFrame:
    """Coherence score clamped to 0..1, before the stretch per scene.

    Scoring is unrolled column arithmetic over the attached model row.  The sign
    of the projection is kept, so opposite spectra score 0; a zero denominator
    scores 0; scenes without a model get a null score and say why in ``status``.
    """
    bands = band_columns(table)
    n = len(bands)
    pairs = list(enumerate(np.transpose(np.triu_indices(n)).tolist()))
    # Plain columns and values that cannot be null shorten the generated code.
    flat = coherence_model(table).selectExpr(
        "scene_id", "status", "_t", *[f"_mean[{i}] AS _m{i}" for i in range(n)],
        *[f"_u[{i}] AS _u{i}" for i in range(n)], *[f"_w[{k}] AS _w{k}" for k, _ in pairs])
    scored = attach(table, flat, ["scene_id"])
    known = " AND ".join(f"{c} IS NOT NULL" for c in ["_t", *bands])
    centred = scored.selectExpr("*", f"{known} AS _known",
                                *[f"coalesce(double({c}) - _m{i}, 0D) AS _x{i}" for i, c in enumerate(bands)])
    g = " + ".join(f"coalesce(_u{i}, 0D) * _x{i}" for i in range(n))
    q = " + ".join(f"coalesce(_w{k}, 0D) * _x{i} * _x{j}" for k, (i, j) in pairs)
    ratio = centred.selectExpr(*table.columns, "status", "_known", f"{g} AS _g", f"coalesce(_t, 0D) * ({q}) AS _d").selectExpr(
        "*", "coalesce(_g * abs(_g) / nullif(_d, 0D), 0D) AS _r")
    return ratio.selectExpr(*table.columns, "status", "CASE WHEN _known THEN least(greatest(_r, 0D), 1D) END AS score")


def ace_score(signal: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Coherence score of every pixel with its scene's target, stretched to 0..1.

    The target is the mean spectrum of pixels labelled 255, from ``mask`` or from
    a ``label`` column of the signal.
    """
    table = signal if mask is None else materialise(with_mask(signal, mask))        # read three times
    return minmax_columns(ace_raw(table), ["scene_id"], {"score": F.col("score")}, 0.0, 1.0, rounded=False)


def forest_score(signal: DataFrame, mask: DataFrame | None = None, n: int = 1000, trees: int = 50,
                 seed: int = 7) -> DataFrame:
    """Foreground class and probability from a random forest on all bands.

    One forest is trained on the balanced samples of all scenes.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    table = signal if mask is None else materialise(with_mask(signal, mask))        # read to train and to score
    bands = band_columns(table)
    unit = table.withColumns({f"_f{i}": F.col(c) / F.lit(255.0) for i, c in enumerate(bands)})
    sample = materialise(balanced_sample(unit, n).withColumn("_class", (F.col("label") == 255).cast("double")))
    assemble = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(bands))], outputCol="_features",
                               handleInvalid="skip")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_class", maxDepth=7, minInstancesPerNode=50,
                                    featureSubsetStrategy="all", numTrees=trees, seed=seed)
    model = Pipeline(stages=[assemble, forest]).fit(sample)
    whole = reduce(lambda a, b: a & b, [F.col(f"_f{i}").isNotNull() for i in range(len(bands))])
    scored = model.transform(unit.filter(whole)).select(
        *PIXEL, F.col("prediction").alias("score"), vector_to_array("probability")[1].alias("probability"))
    # A pixel without all bands keeps its row, without a score.
    none = F.lit(None).cast("double")
    return scored.unionByName(unit.filter(~whole).select(*PIXEL, none.alias("score"), none.alias("probability")))
