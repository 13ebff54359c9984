import hashlib

import numpy as np
import pandas as pd
from helpers import signal, table
from pyspark.sql import functions as F

from bandscape.operators import forest as FO
from bandscape.operators.masks import balanced_sample

RNG = np.random.default_rng(8)


def cube(h=40, w=45, noise=30):
    label = np.where(np.add.outer(np.arange(h) // 6, np.arange(w) // 9) % 2 == 0, 255, 0)
    bands = np.stack([np.where(label > 0, 90, 140), np.where(label > 0, 120, 110), np.full((h, w), 60)], 2)
    return np.clip(bands + RNG.integers(-noise, noise + 1, bands.shape), 0, 255), label


def drawn(scene, y, x, tree, seed):
    number = int(hashlib.md5(f"{scene}|{y}|{x}|{tree}|{seed}".encode()).hexdigest()[:8], 16)
    return sum(number >= int(s * 2 ** 32) for s in FO.SHARES)


def grown(v, hit, w, node=1, depth=0):
    """Nodes of one tree by trying every split."""
    n, t = int(w.sum()), int((w * hit).sum())

    def purity(m, k):
        return (float(k) * k + float(m - k) * (m - k)) / m

    best = None
    for band in range(v.shape[1]):
        for value in np.unique(v[:, band]):
            left = v[:, band] <= value
            m, k = int(w[left].sum()), int((w * hit)[left].sum())
            if depth < FO.DEPTH and m >= FO.LEAST and n - m >= FO.LEAST:
                gain = purity(m, k) + purity(n - m, t - k) - purity(n, t)
                if gain > 1e-9 and (best is None or (-round(gain, 9), band + 1, value) < best):
                    best = (-round(gain, 9), band + 1, float(value))
    if best is None:
        return {node: (n, t, None, None)}
    right = v[:, best[1] - 1] > best[2]
    return {node: (n, t, *best[1:]), **grown(v[~right], hit[~right], w[~right], 2 * node, depth + 1),
            **grown(v[right], hit[right], w[right], 2 * node + 1, depth + 1)}


def forests(sample, trees, seed):
    out = {}
    for scene, part in sample.groupby("scene_id"):
        for tree in range(1, trees + 1):
            w = np.array([drawn(scene, r.y, r.x, tree, seed) for r in part.itertuples()])
            v = part[["b1", "b2", "b3"]].to_numpy(float)[w > 0]
            out[scene, tree] = grown(v, (part.label == 255).to_numpy()[w > 0], w[w > 0])
    return out


def vote(forest, row):
    shares = []
    for nodes in forest:
        node = 1
        while nodes[node][2] is not None:
            node = 2 * node + (row[nodes[node][2] - 1] > nodes[node][3])
        shares.append(nodes[node][1] / nodes[node][0])
    return sum(shares) / len(shares)


def test_every_split_and_score_equals_brute_force(spark):
    scenes = [cube(), cube(30, 20, 60)]
    df = signal(spark, *scenes[0]).unionByName(signal(spark, *scenes[1], scene=1))
    want = forests(balanced_sample(df, 300).toPandas(), 4, 3)
    model = FO.grow(FO.bootstrap(balanced_sample(df, 300), 4, 3)).toPandas()
    got = {(r.scene_id, r.tree, r.node): (r.n, r.hits, None if pd.isna(r.band) else r.band, None if pd.isna(r.band) else r.value)
           for r in model.itertuples()}
    assert got == {(*key, node): value for key, nodes in want.items() for node, value in nodes.items()}
    assert max(node for _, _, node in got) > 7 and len(got) == len(model)
    for bits in (3, 8):
        scored = FO.scene_forests(df, n=300, trees=4, seed=3, bits=bits).toPandas()
        assert len(scored) == 40 * 45 + 30 * 20
        for r in scored.sample(300, random_state=1).itertuples():
            chance = vote([want[r.scene_id, t] for t in range(1, 5)], scenes[r.scene_id][0][r.y, r.x])
            assert abs(r.probability - chance) < 1e-12 and r.score == float(r.probability > 0.5)


def test_a_scene_learns_from_itself_alone(spark):
    """The same colours mean the opposite in the other scene."""
    bands, label = cube()
    df = signal(spark, bands, label).unionByName(signal(spark, bands, 255 - label, scene=1))
    scored = FO.scene_forests(df, trees=10).join(df, ["scene_id", "y", "x"]).toPandas()
    for _, part in scored.groupby("scene_id"):
        assert ((part.score == 1) == (part.label == 255)).mean() > 0.8
    alone = FO.scene_forests(signal(spark, bands, label), trees=10).toPandas().set_index(["y", "x"]).probability
    both = scored[scored.scene_id == 0].set_index(["y", "x"]).probability
    assert (both.sort_index() - alone.sort_index()).abs().max() == 0


def test_scenes_without_a_class_and_pixels_without_a_band(spark):
    bands, label = cube(8, 9)
    df = signal(spark, bands, label).withColumn("b2", F.when(F.col("y") != 3, F.col("b2")))
    df = df.unionByName(signal(spark, bands, np.zeros((8, 9), int), scene=1))
    out = FO.scene_forests(df, trees=3).toPandas()
    assert len(out) == 2 * 8 * 9
    assert out[out.scene_id == 1].score.isna().all()
    assert (out[out.scene_id == 0].score.isna() == (out[out.scene_id == 0].y == 3)).all()
    small = out[(out.scene_id == 0) & (out.y != 3)].probability
    assert small.nunique() == 1                             # too few pixels for a split


def test_mask_and_empty_table(spark):
    bands, label = cube(20, 20)
    mask = table(spark, {0: label}, "label")
    with_mask = FO.scene_forests(signal(spark, bands), mask, trees=2).toPandas().sort_values(["y", "x"])
    inside = FO.scene_forests(signal(spark, bands, label), trees=2).toPandas().sort_values(["y", "x"])
    assert (with_mask.probability.to_numpy() == inside.probability.to_numpy()).all()
    assert FO.scene_forests(signal(spark, bands, label).limit(0), trees=2).count() == 0
