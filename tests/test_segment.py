import numpy as np
import pytest
from helpers import image, signal, table
from pyspark.sql import functions as F

from bandscape.operators import bands as B
from bandscape.operators import masks as M
from bandscape.operators import segment as SG
from bandscape.plans import scenes as PL
from bandscape.sources.sinks import rotate_quarter

RNG = np.random.default_rng(2)


def page(h=30, w=40):
    """A light page with dark strokes in eight bands; the last band sees no ink."""
    ink = np.zeros((h, w), bool)
    for x in range(4, w - 4, 8):
        ink[4:h - 4, x:x + 3] = True
    cube = np.full((h, w, 8), 200) + RNG.integers(-12, 13, (h, w, 8))
    cube[ink, :7] -= 120
    return np.clip(cube, 0, 255), ink


CUBE, INK = page()


def features(spark, scene=0):
    df = B.feature_composite(signal(spark, CUBE, np.where(INK, 255, 0), scene))
    scored = df.withColumn("score", F.when(F.col("label") > 0, 0.8).otherwise(F.col("c1") / 5000.0))
    return B.trimap(scored).select("scene_id", "y", "x", "c0", "c1", "c2", "score", F.col("label").alias("base"), "trimap")


def pixels(spark, scene=0):
    return B.to_pixels(signal(spark, CUBE, scene=scene))


def test_mixture_finds_the_strokes(spark):
    out = image(SG.gmm_segment(features(spark)), "label") > 0
    assert (out == INK).mean() > 0.97


def test_sure_pixels_keep_their_side(spark):
    out = SG.gmm_segment(features(spark).withColumn(
        "trimap", F.when(F.col("y") == 0, "FGD").when(F.col("y") == 1, "BGD").otherwise(F.col("trimap"))))
    labels = image(out, "label")
    assert (labels[0] == 255).all() and (labels[1] == 0).all()


@pytest.fixture(scope="module")
def costs(spark):
    # Noisy labels, so that smoothing has work to do.
    noisy = features(spark).withColumn("trimap", F.when(F.col("c0") % 3 == 0, "PR_FGD").otherwise("PR_BGD"))
    rows = SG.gmm_segment(noisy, 0).toPandas()
    return spark.createDataFrame(rows)


def test_smoothing_lowers_the_energy(spark, costs):
    beta = M.contrast_scale(costs)
    energy = [SG.potts_energy(costs, beta).first().energy]
    for sweeps in (1, 3):
        energy.append(SG.potts_energy(SG.smooth_labels(costs, beta, sweeps), beta).first().energy)
    assert energy[0] >= energy[1] >= energy[2] and energy[2] < energy[0]


def test_smoothing_does_not_depend_on_tiles(spark, costs):
    beta = M.contrast_scale(costs)
    whole, cut = (image(SG.smooth_labels(costs, beta, 2, bits), "label") for bits in (8, 3))
    assert (whole == cut).all()


def test_contrast_scale_of_a_constant_scene(spark):
    flat = table(spark, {0: np.full((4, 4), 9)}, "c0").withColumns({"c1": F.col("c0"), "c2": F.col("c0")})
    assert M.contrast_scale(flat).first().beta == 0


def step_by_step(mask, base, limit):
    """Erode until empty or until the overlap is small: what is left, and after how many steps."""
    positive = (base > 0).sum()
    for n in range(1, 101):
        p = np.pad(mask, 1, constant_values=255)
        mask = np.minimum.reduce([mask, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        if not mask.any():
            return mask, n
        if positive and ((mask > 0) & (base > 0)).sum() / positive < limit:
            return mask, n
    return mask, 100


def test_violations_match_stepwise_erosion(spark):
    masks, bases = {}, {}
    for scene in range(6):
        mask = np.zeros((24, 30), int)
        for _ in range(4):
            y, x, s = RNG.integers(0, 16), RNG.integers(0, 20), RNG.integers(2, 10)
            mask[y:y + s, x:x + s] = 255
        base = np.where(RNG.random(mask.shape) < 0.5, mask, 0)
        base[:, 15:] = 0
        masks[scene], bases[scene] = mask, base
    masks[6], bases[6] = np.zeros((5, 5), int), np.zeros((5, 5), int)           # nothing at all
    masks[7], bases[7] = np.full((5, 5), 255), np.zeros((5, 5), int)            # no background, no base
    df = table(spark, masks, "label").join(table(spark, bases, "base"), ["scene_id", "y", "x"])
    out = SG.refine_round(df)
    for scene, mask in masks.items():
        left, n = step_by_step(mask, bases[scene], 5 / 127.5)
        got = image(out.withColumn("v", F.col("violation").cast("int")), "v", scene) > 0
        assert (got == ((left > 0) & (bases[scene] == 0))).all()
        assert out.filter(f"scene_id = {scene}").first().erosions == n


def test_refinement_removes_a_stain(spark):
    cube, ink = CUBE.copy(), INK.copy()
    cube[6:24, 26:38, :7] = 80                                                  # a stain as dark as ink
    df = B.feature_composite(signal(spark, cube, np.where(ink & (np.arange(40) < 24), 255, 0)))
    scored = df.withColumn("score", F.when(F.col("c1") < 120, 0.9).otherwise(0.0))
    out = image(SG.refine(scored.withColumnRenamed("label", "base"), kmeans_rounds=1), "label") > 0
    strokes = ink[:, :24]
    assert (out[:, :24] == strokes).mean() > 0.95
    assert out[12:18, 30:34].mean() < 0.5


def test_multispectral_scenes(spark):
    px = pixels(spark).unionByName(pixels(spark, 1)).unionByName(pixels(spark, 2).filter("band < 8"))
    out = PL.binarize_msi(px, kmeans_rounds=1)
    assert {r.scene_id for r in out.select("scene_id").distinct().collect()} == {0, 1}
    for scene in (0, 1):
        assert ((image(out, "label", scene) > 0) == INK).mean() > 0.95


def test_colour_scenes(spark):
    px = pixels(spark).filter("band <= 3")
    out = image(PL.binarize_rgb(px, kmeans_rounds=1), "label") > 0
    assert (out == INK).mean() > 0.95


def test_score_map_of_scenes_with_different_band_counts(spark):
    px = pixels(spark).unionByName(pixels(spark, 1).filter("band <= 4")).unionByName(pixels(spark, 2))
    mask = table(spark, {0: np.where(INK, 255, 0), 1: np.where(INK, 255, 0)}, "label")
    out = PL.ace_map(px, mask)
    assert {r.scene_id for r in out.select("scene_id").distinct().collect()} == {0, 1}      # 2 has no mask
    for scene in (0, 1):
        score = image(rotate_quarter(out, 3), "score", scene)
        assert score.shape == INK.shape
        assert score[INK].mean() > 0.5 > score[~INK].mean()


def test_colour_view(spark):
    out = PL.visualize_msi(pixels(spark)).toPandas()
    assert len(out) == INK.size and out[["r", "g", "b"]].stack().between(0, 255).all()


def test_smoothing_rests(spark, costs):
    beta = M.contrast_scale(costs)
    once = SG.smooth_labels(costs, beta, 1)
    assert (image(once, "label") == image(SG.smooth_labels(once, beta, 4), "label")).all()


def stained(width):
    """A scene that leaves the refinement after more rounds the wider its stain."""
    cube, ink = CUBE.copy(), INK.copy()
    if width:
        cube[6:24, 26:26 + width, :7] = 80
    return cube, ink & (np.arange(40) < 24)


def test_every_scene_is_refined_as_if_alone(spark):
    def features_of(scene, width):
        cube, ink = stained(width)
        df = B.feature_composite(signal(spark, cube, np.where(ink, 255, 0), scene))
        return df.withColumn("score", F.when(F.col("c1") < 120, 0.9).otherwise(0.0)).withColumnRenamed("label", "base")

    tables = [features_of(k, w) for k, w in enumerate((0, 6, 12))]
    both = tables[0].unionByName(tables[1]).unionByName(tables[2])
    together = SG.refine(both, kmeans_rounds=2)
    for k, alone in enumerate(tables):
        assert (image(SG.refine(alone, kmeans_rounds=2), "label", k) == image(together, "label", k)).all()
    assert together.select("settled").distinct().count() == 1


def test_masks_come_with_the_bands(spark):
    """So the signal need not be joined to them by pixel."""
    grey = signal(spark, CUBE).withColumn("value", F.col("b2"))
    out = PL.rough_masks(grey, 3, stroke=2)
    assert {"b1", "b8", "label", "base"} <= set(out.columns) and out.count() == INK.size
    assert (image(out, "b5") == CUBE[..., 4]).all()
