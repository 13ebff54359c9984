"""Tile windows give the same result whatever the tile size, and match brute force."""

import numpy as np
import pytest
from helpers import image, table
from pyspark.sql import functions as F

from bandscape.functions import tiles as tl
from bandscape.operators import masks as M
from bandscape.operators import neighborhood as N

RNG = np.random.default_rng(5)
GREY = RNG.integers(0, 256, (21, 27))
MASK = np.where(RNG.random((21, 27)) < 0.8, 255, 0)


def windows(a, r):
    h, w = a.shape
    return {(y, x): a[max(y - r, 0):y + r + 1, max(x - r, 0):x + r + 1] for y in range(h) for x in range(w)}


@pytest.mark.parametrize("bits", [2, 8])
def test_contrast(spark, bits):
    got = image(N.local_contrast(table(spark, {0: GREY, 1: GREY.T}, "value"), bits=bits), "contrast")
    for (y, x), box in windows(GREY.astype(float), 1).items():
        assert got[y, x] == pytest.approx((box.max() - box.min()) / (box.max() + box.min() + 1e-6))


@pytest.mark.parametrize("bits", [2, 8])
def test_median_replicates_the_border(spark, bits):
    got = image(N.median_smooth(table(spark, {0: GREY}, "value"), "value", 5, bits), "value")
    padded = np.pad(GREY, 2, mode="edge")
    want = np.array([[np.median(padded[y:y + 5, x:x + 5]) for x in range(27)] for y in range(21)])
    assert (got == want).all()


@pytest.mark.parametrize("n, bits", [(1, 8), (2, 3), (3, 2)])
def test_erosion_equals_repeated_cross(spark, n, bits):
    want = MASK.copy()
    for _ in range(n):
        p = np.pad(want, 1, constant_values=255)
        want = np.minimum.reduce([want, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    got = image(N.erode(table(spark, {0: MASK}, "label"), n, bits=bits), "label")
    assert (got == want).all() and (got <= MASK).all()


def test_erosion_of_full_mask_keeps_it(spark):
    full = np.full((6, 7), 255)
    assert (image(N.erode(table(spark, {0: full}, "label"), 3), "label") == full).all()


def test_border_erosion_window_is_anchored_at_its_middle(spark):
    got = image(N.erode_border(table(spark, {0: MASK}, "label"), 4, bits=3), "label")
    want = np.array([[MASK[max(y - 2, 0):y + 2, max(x - 2, 0):x + 2].min() for x in range(27)] for y in range(21)])
    assert (got == want).all()


@pytest.mark.parametrize("d, bits", [(3, 2), (5.5, 3), (1, 2), (50, 8)])
def test_keep_near_matches_brute_force(spark, d, bits):
    anchors = np.argwhere(RNG.random(MASK.shape) < 0.01)
    a = spark.createDataFrame([(0, int(y), int(x)) for y, x in anchors], "scene_id bigint, y int, x int")
    got = {(r.y, r.x) for r in M.keep_near(table(spark, {0: MASK}, "label"), a, d, bits).collect()}
    want = {(y, x) for y, x in np.argwhere(MASK > 0).tolist()
            if ((anchors - [y, x]) ** 2).sum(1).min() < d * d}
    assert got == want


def test_dynamic_radius_selects_the_right_window(spark):
    images = {1: GREY, 2: GREY, 7: GREY}
    df = table(spark, images, "value").withColumn("r", __import__("pyspark").sql.functions.col("scene_id").cast("int"))
    from pyspark.sql import functions as F
    out = tl.box_aggregate(df, {"s": ("sum", F.col("value"))}, F.col("r"), bits=3)
    for scene in images:
        got = image(out, "s", scene)
        for (y, x), box in windows(GREY, scene).items():
            assert got[y, x] == box.sum()


def test_neighbour_pairs_of_a_sparse_table(spark):
    points = {(0, 0), (0, 1), (1, 2), (3, 3), (4, 2), (4, 4), (5, 3)}
    df = spark.createDataFrame([(0, y, x, y * 10 + x) for y, x in points], "scene_id bigint, y int, x int, v int")
    got = {(r.y, r.x, r.y + r.dy, r.x + r.dx) for r in M.neighbor_pairs(df, ["v"], bits=2).collect()}
    want = {(*a, *b) for a in points for b in points if a < b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}
    assert got == want
    assert all(r.v_n == (r.y + r.dy) * 10 + r.x + r.dx for r in M.neighbor_pairs(df, ["v"], bits=2).collect())


def test_windows_use_one_shuffle(spark):
    df = table(spark, {0: GREY}, "value")
    plan = N.local_contrast(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_run_edges_across_column_blocks(spark):
    runs = spark.createDataFrame([(0, 0, 0, 9), (0, 1, 3, 3), (0, 1, 10, 12), (0, 1, 14, 15), (0, 2, 0, 15)],
                                 "scene_id bigint, y int, x0 int, x1 int")
    got = {(r.y, r.ax0, r.bx0) for r in M.run_edges(runs, block=4).collect()}
    assert got == {(0, 0, 3), (0, 0, 10), (1, 3, 0), (1, 10, 0), (1, 14, 0)}
    assert M.run_edges(runs, block=4).count() == len(got)


def test_radius_beyond_a_thousand(spark):
    wide = np.zeros((1, 5200), int)
    wide[0, [0, 1500, 1501, 5000]] = [5, 7, 1, 2]
    df = table(spark, {0: wide, 1: wide[:, :40]}, "value").withColumn("r", F.when(F.col("scene_id") == 0, 1500).otherwise(3))
    out = tl.box_aggregate(df, {"s": ("sum", F.col("value"))}, F.col("r"))
    got = image(out, "s")[0]
    assert (got == [wide[0, max(0, x - 1500):x + 1501].sum() for x in range(5200)]).all()
    assert (image(out, "s", 1)[0] == [wide[0, max(0, x - 3):min(40, x + 4)].sum() for x in range(40)]).all()
