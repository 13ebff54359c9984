import numpy as np
import pytest
from helpers import image, signal, table
from pyspark.sql import functions as F

from bandscape.functions import joins as J
from bandscape.operators import bands as B
from bandscape.operators import masks as M
from bandscape.operators import score as SC
from bandscape.operators import stats as ST

RNG = np.random.default_rng(11)
CUBE = RNG.integers(0, 256, (9, 10, 8))
LABEL = np.where(CUBE[:, :, 1] > 170, 255, 0)
LABEL[0, 0] = 100


def expected(cube, label):
    x = cube.reshape(-1, cube.shape[2]) / 255.0
    s = x[label.ravel() == 255].mean(0) - x.mean(0)
    x = x - x.mean(0)
    inverse = np.linalg.pinv(x.T @ x / (len(x) - 1), rcond=1e-12)
    g = x @ inverse @ s
    q = (x @ inverse * x).sum(1)
    raw = np.clip(np.divide(g * abs(g), (s @ inverse @ s) * q, out=np.zeros_like(g), where=q != 0), 0, 1)
    return ((raw - raw.min()) / (raw.max() - raw.min())).reshape(label.shape)


def test_eight_bands_match_numpy(spark):
    got = image(SC.ace_score(signal(spark, CUBE, LABEL)), "score")
    np.testing.assert_allclose(got, expected(CUBE, LABEL), atol=1e-9)


def test_scaling_a_band_changes_nothing(spark):
    scaled = CUBE * np.array([1, 1, 3, 1, 1, 1, 1, 1])
    got = image(SC.ace_score(signal(spark, scaled, LABEL)), "score")
    np.testing.assert_allclose(got, expected(CUBE, LABEL), atol=1e-9)


def test_constant_band_is_left_out(spark):
    cube = CUBE.copy()
    cube[:, :, 3] = 77
    got = image(SC.ace_score(signal(spark, cube, LABEL)), "score")
    np.testing.assert_allclose(got, expected(np.delete(cube, 3, 2), LABEL), atol=1e-7)


def test_scene_without_target(spark):
    both = signal(spark, CUBE, LABEL).unionByName(signal(spark, CUBE, np.zeros_like(LABEL), scene=1))
    out = SC.ace_score(both)
    assert {r.status for r in out.filter("scene_id = 1").collect()} == {"no_target"}
    assert out.filter("scene_id = 1 AND score IS NOT NULL").count() == 0
    assert out.filter("scene_id = 0 AND score IS NULL").count() == 0


def test_outliers_use_the_quartile_fence(spark):
    out = image(ST.flag_outliers(signal(spark, CUBE[:, :, :2], LABEL)), "label")
    ink = LABEL > 0
    want = LABEL.copy()
    for k in range(2):
        a, b = np.quantile(CUBE[:, :, k][ink], [0.25, 0.75])
        lo, hi = np.floor(np.clip([a - 1.5 * (b - a), b + 1.5 * (b - a)], 0, 255))
        want[ink & ((CUBE[:, :, k] < lo) | (CUBE[:, :, k] > hi))] = 100
    assert (out == want).all()


def test_stretch_is_idempotent_and_constant_becomes_zero(spark):
    once = B.minmax(table(spark, {0: CUBE[:, :, 0], 1: np.full((3, 3), 9)}, "value"), ["scene_id"])
    twice = B.minmax(once, ["scene_id"])
    assert (image(once, "value") == image(twice, "value")).all()
    assert image(once, "value", 1).sum() == 0


def test_background_of_another_size_is_not_removed(spark):
    px = (table(spark, {0: CUBE[:, :, 0]}, "value").withColumn("band", F.lit(2))
          .unionByName(table(spark, {0: CUBE[:5, :, 1]}, "value").withColumn("band", F.lit(3))))
    out = image(B.remove_background(B.to_signal(px, 3)), "value")
    assert (out == CUBE[:, :, 0]).all()


def test_trimap_and_mask_agree_where_score_and_mask_do(spark):
    scored = signal(spark, CUBE, LABEL).withColumn("score", (F.col("label") == 255).cast("double"))
    for preset in ("score", "forest"):
        back = image(B.trimap_to_mask(B.trimap(scored.filter("label <> 100"), preset=preset)), "label")
        assert (back == np.where(LABEL == 255, 255, 0)).all()


def test_balanced_sample_is_evenly_spaced(spark):
    df = table(spark, {0: LABEL}, "label")
    got = {(r.y, r.x) for r in M.balanced_sample(df, 7, rows=2, columns=3).collect()}
    want = set()
    for value in (255, 0):
        places = np.argwhere(LABEL == value)
        want |= {tuple(places[i * len(places) // 7]) for i in range(7)}
    assert got == want


@pytest.mark.parametrize("n", [7, 1000])                    # of a sample query, and of a forest
def test_balanced_sample_of_many_strips_is_not_broadcast(spark, n):
    df = table(spark, {k: np.roll(LABEL, k, 0) for k in range(3)}, "label")
    want = sorted(map(tuple, M.balanced_sample(df, n, rows=2, columns=3).collect()))
    spark.conf.set(J.BROADCAST_ROWS, "0")
    try:
        sample = M.balanced_sample(df, n, rows=2, columns=3)
    finally:
        spark.conf.unset(J.BROADCAST_ROWS)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "_salt" not in plan
    assert sorted(map(tuple, sample.collect())) == want


def test_no_step_of_a_balanced_sample_is_broadcast_beyond_the_limit(spark, monkeypatch):
    written, plans = J.materialise, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    for module in (M, J):
        monkeypatch.setattr(module, "materialise", noted)
    df = table(spark, {k: np.roll(LABEL, k, 0) for k in range(3)}, "label")
    want = sorted(map(tuple, M.balanced_sample(df, 7, rows=2, columns=3).collect()))
    plans.clear()
    spark.conf.set(J.BROADCAST_ROWS, "0")
    try:
        sample = M.balanced_sample(df, 7, rows=2, columns=3)
    finally:
        spark.conf.unset(J.BROADCAST_ROWS)
    assert any("SortMergeJoin" in plan for plan in plans)
    assert not any("BroadcastHashJoin" in plan for plan in plans)
    assert sorted(map(tuple, sample.collect())) == want


def test_balanced_sample_needs_both_classes(spark):
    assert M.balanced_sample(table(spark, {0: np.full((3, 3), 255)}, "label")).count() == 0


def test_forest_separates_classes(spark):
    cube = np.where((LABEL == 255)[:, :, None], 200, 50) + RNG.integers(0, 20, CUBE.shape)
    big, label = np.tile(cube, (4, 3, 1)), np.tile(np.where(LABEL == 255, 255, 0), (4, 3))
    out = SC.forest_score(signal(spark, big, label), trees=5)
    assert (image(out, "score") == (label == 255)).all()


def test_forest_keeps_rows_with_a_missing_band(spark):
    rng = np.random.default_rng(1)
    cube = rng.integers(0, 256, (20, 20, 3))
    df = signal(spark, cube, np.where(cube[:, :, 0] > 128, 255, 0))
    df = df.withColumn("b2", F.when((F.col("y") > 0) | (F.col("x") > 4), F.col("b2")))
    out = SC.forest_score(df, n=100, trees=3).toPandas()
    assert len(out) == 400 and out.score.isna().sum() == 5 and out.score.dropna().isin([0.0, 1.0]).all()
