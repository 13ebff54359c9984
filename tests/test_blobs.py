import numpy as np
import pytest
from helpers import image, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bandscape.operators import blobs as BL


def flood(mask):
    """First pixel in raster order of the 8-connected region of each pixel."""
    names, h, w = {}, *mask.shape
    for start in map(tuple, np.argwhere(mask > 0)):
        if start in names:
            continue
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in names or not (0 <= y < h and 0 <= x < w) or mask[y, x] == 0:
                continue
            names[(y, x)] = (int(start[0]) << 32) + int(start[1])
            stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return names


def labels(df):
    return {(r.y, r.x): r.blob_id for r in df.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), density=st.sampled_from([0.3, 0.45, 0.6]), bits=st.sampled_from([1, 2, 3]))
def test_labels_match_flood_fill(spark, seed, density, bits):
    mask = np.where(np.random.default_rng(seed).random((13, 17)) < density, 255, 0)
    mask[0, 0] = 255
    assert labels(BL.label_blobs(table(spark, {0: mask}, "label"), bits)) == flood(mask)


@pytest.mark.parametrize("bits", [1, 2])
def test_spiral_over_many_tiles(spark, bits):
    mask = np.zeros((15, 15), int)
    y = x = 0
    dy, dx, turn = 0, 1, 0
    mask[0, 0] = 255
    for length in (14, 14, 14, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4, 2, 2):
        for _ in range(length):
            y, x = y + dy, x + dx
            mask[y, x] = 255
        dy, dx = dx, -dy
    ids = labels(BL.label_blobs(table(spark, {0: mask}, "label"), bits))
    assert ids == flood(mask) and len(set(ids.values())) == 1


def test_scenes_stay_apart(spark):
    one = np.full((5, 5), 255)
    out = BL.blob_areas(BL.label_blobs(table(spark, {0: one, 1: one}, "label"), 1)).collect()
    assert sorted((r.scene_id, r.blob_id, r.area) for r in out) == [(0, 0, 25), (1, 0, 25)]


def test_small_blobs_are_cleared(spark):
    mask = np.zeros((5, 9), int)
    mask[0, :3], mask[2:4, 5:8] = 255, 255
    out = image(BL.filter_blobs(table(spark, {0: mask}, "label"), 3, bits=2), "label")
    assert out.sum() == 6 * 255 and out[0].sum() == 0


def test_isolated_blobs_are_cleared(spark):
    mask = np.zeros((40, 60), int)
    mask[5:11, 5:11] = 255                       # large
    mask[12, 13] = mask[30, 50] = 255            # near it, and far away
    out = image(BL.remove_isolated(table(spark, {0: mask}, "label"), d=10, bits=4), "label")
    assert out[12, 13] == 255 and out[30, 50] == 0 and out[5:11, 5:11].all()


def test_empty_mask(spark):
    empty = table(spark, {0: np.zeros((4, 4), int)}, "label")
    assert BL.label_blobs(empty).count() == 0
    assert image(BL.remove_isolated(empty), "label").sum() == 0


def comb(teeth, length):
    mask = np.zeros((length, 4 * teeth - 3), int)
    mask[:, ::4] = 255
    mask[-1] = 255
    return mask


@pytest.mark.parametrize("mask", [comb(2, 160), comb(12, 20)], ids=["U", "comb"])
def test_long_regions_settle_in_few_rounds(spark, monkeypatch, mask):
    from bandscape.functions import graph
    rounds = []
    monkeypatch.setattr(graph, "_digest", lambda pairs, digest=graph._digest: rounds.append(1) or digest(pairs))
    ids = labels(BL.label_blobs(table(spark, {0: mask}, "label"), 1))
    tiles = mask.size / 4
    assert set(ids.values()) == {0} and len(rounds) <= 2 * np.log2(tiles)
