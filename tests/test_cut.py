from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandscape.operators import cut as C
from bandscape.operators import masks as M
from bandscape.operators import segment as SG

STEPS = [(0, 1), (1, -1), (1, 0), (1, 1)]


def scenes(shapes, strength, seed, pinned=0.0, holes=0.0):
    rng = np.random.default_rng(seed)
    parts = []
    for scene, (h, w) in enumerate(shapes):
        y, x = (a.ravel() for a in np.indices((h, w)))
        kind = rng.choice(["PR_FGD", "PR_BGD", "FGD", "BGD"], h * w, p=[0.5 - pinned, 0.5 - pinned, pinned, pinned])
        part = pd.DataFrame({"scene_id": scene, "y": y, "x": x, **{c: rng.integers(0, 40, h * w) for c in C.COLOURS},
                             "trimap": kind, "fg_cost": rng.normal(0, strength, h * w) + 5, "bg_cost": 5.0})
        parts.append(part[rng.random(h * w) >= holes])
    return pd.concat(parts, ignore_index=True)


def graph(part, beta):
    """Whole costs of the foreground over the background, and whole weights by pairs of row numbers."""
    at = {(r.y, r.x): i for i, r in enumerate(part.itertuples())}
    colours = part[C.COLOURS].to_numpy(float)
    gain = np.rint(np.clip((part.fg_cost - part.bg_cost) * C.SCALE, -C.SURE, C.SURE)).astype(int).to_numpy()
    gain = np.where(part.trimap == "FGD", -C.SURE, np.where(part.trimap == "BGD", C.SURE, gain))
    pairs = {}
    for (y, x), i in at.items():
        for dy, dx in STEPS:
            j = at.get((y + dy, x + dx))
            if j is not None:
                gap = ((colours[i] - colours[j]) ** 2).sum()
                pairs[i, j] = int(np.rint(C.GAMMA * C.SCALE * np.exp(-beta * gap) / np.hypot(dy, dx)))
    return gain, pairs


def energy(label, gain, pairs):
    return int(gain[label].sum()) + sum(w for (i, j), w in pairs.items() if label[i] != label[j])


def least_cut(gain, pairs):
    """Shortest augmenting paths; the foreground is what can still reach its terminal."""
    n = len(gain)
    room = [dict() for _ in range(n + 2)]
    for i, g in enumerate(gain):
        room[n][i], room[i][n] = max(int(g), 0), 0
        room[i][n + 1], room[n + 1][i] = max(-int(g), 0), 0
    for (i, j), w in pairs.items():
        room[i][j] = room[j][i] = w
    while True:
        before, todo = {n: n}, deque([n])
        while todo and n + 1 not in before:
            p = todo.popleft()
            for q, c in room[p].items():
                if c > 0 and q not in before:
                    before[q] = p
                    todo.append(q)
        if n + 1 not in before:
            break
        path, q = [], n + 1
        while q != n:
            path.append((before[q], q))
            q = before[q]
        amount = min(room[p][q] for p, q in path)
        for p, q in path:
            room[p][q] -= amount
            room[q][p] += amount
    reach, todo = {n + 1}, deque([n + 1])
    while todo:
        q = todo.popleft()
        for p in room[q]:
            if p not in reach and room[p][q] > 0:
                reach.add(p)
                todo.append(p)
    return np.array([i in reach for i in range(n)])


def run(spark, rows, beta, bits, cut=C.cut_labels):
    scales = spark.createDataFrame([(int(s), beta) for s in rows.scene_id.unique()], "scene_id long, beta double")
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1)).withColumns({c: F.col(c).cast("int") for c in ("y", "x")})
    out = cut(df, scales, bits).toPandas()
    assert len(out) == len(rows)
    merged = rows.merge(out[["scene_id", "y", "x", "label"]], on=["scene_id", "y", "x"])
    assert len(merged) == len(rows)
    return merged


@pytest.mark.parametrize("strength, beta, pinned, holes", [(60, 0.001, 0, 0), (150, 0.002, 0.02, 0.1), (20, 0.0, 0.05, 0)])
def test_equals_every_labelling(spark, strength, beta, pinned, holes):
    rows = scenes([(3, 4), (4, 3), (2, 6), (1, 9), (1, 1)] * 2, strength, 3, pinned, holes)
    out = run(spark, rows, beta, 1)
    for scene, part in out.groupby("scene_id"):
        part = part.reset_index(drop=True)
        gain, pairs = graph(part, beta)
        every = [energy(np.array([k >> i & 1 for i in range(len(part))], bool), gain, pairs) for k in range(1 << len(part))]
        assert energy((part.label == 255).to_numpy(), gain, pairs) == min(every)
        sure = part.trimap.isin(["FGD", "BGD"])
        assert ((part.label == 255) == (part.trimap == "FGD"))[sure].all()


@pytest.mark.parametrize("bits, strength", [(2, 700), (4, 80), (8, 80)])
def test_equals_augmenting_paths(spark, bits, strength):
    rows = scenes([(14, 17), (9, 30), (21, 8)], strength, bits, 0.01, 0.05)
    out = run(spark, rows, 0.0008, bits)
    for _, part in out.groupby("scene_id"):
        gain, pairs = graph(part.reset_index(drop=True), 0.0008)
        assert ((part.label == 255).to_numpy() == least_cut(gain, pairs)).all()


def test_push_relabel_alone(spark, monkeypatch):
    """Tiles decide nothing by themselves, so that all pixels are pushed."""
    decide = C._decide

    def nothing(y, x, gain, arcs, *_):
        return np.full(len(y), -1), gain, arcs, np.ones(len(y), bool)

    monkeypatch.setattr(C, "_decide", nothing)
    rows = scenes([(8, 9), (5, 12)], 200, 11, 0.02)
    out = run(spark, rows, 0.0008, 3)
    monkeypatch.setattr(C, "_decide", decide)
    for _, part in out.groupby("scene_id"):
        gain, pairs = graph(part.reset_index(drop=True), 0.0008)
        assert ((part.label == 255).to_numpy() == least_cut(gain, pairs)).all()


def test_turns_of_tiny_tiles():
    """The rounds of push-relabel on tiles of 4 x 4 pixels, one after another in this process."""
    part = scenes([(11, 15)], 60, 4, 0.01, 0.05).reset_index(drop=True)
    gain, pairs = graph(part, 0.0008)
    arcs = np.zeros((8, len(part)), int)
    for (i, j), w in pairs.items():
        step = C._STEPS.index((part.y[j] - part.y[i], part.x[j] - part.x[i]))
        arcs[step, i] = arcs[7 - step, j] = w
    state = part[["y", "x"]].assign(excess=np.maximum(gain, 0), sink=np.maximum(-gain, 0), _arcs=list(arcs.T), row=range(len(part)))
    label, tilings = np.full(len(part), -1), C._tilings(2)

    def turn(state, shift, push):
        tiles = [(state[c].to_numpy() + s) >> 2 for c, s in zip("yx", shift)]
        return pd.concat([C._turn(rows, key, 2, shift, push) for key, rows in state.groupby(tiles)], ignore_index=True)

    while len(state):
        state, still, n = state.assign(far=C._FAR), 0, 0
        while still < 4:
            state, n = turn(state, tilings[n % 4], False), n + 1
            still = 0 if state.moved.any() else still + 1
        label[state.row[state.far >= C._FAR]] = 0
        state = state[state.far < C._FAR].reset_index(drop=True)
        if not (state.excess > 0).any():
            label[state.row] = 255
            break
        for shift in tilings:
            state = turn(state, shift, True)
    assert ((label == 255) == least_cut(gain, pairs)).all()


def test_never_above_the_descent(spark):
    rows = scenes([(24, 24), (16, 40)], 60, 5)
    df = spark.createDataFrame(rows).withColumns({**{c: F.col(c).cast("int") for c in ("y", "x")}, "label": F.lit(0).cast("smallint")})
    beta = M.contrast_scale(df)
    descent = {r.scene_id: r.energy for r in SG.potts_energy(SG.smooth_labels(df, beta), beta).collect()}
    least = {r.scene_id: r.energy for r in SG.potts_energy(C.cut_labels(df, beta), beta).collect()}
    assert all(least[s] <= descent[s] + 1e-2 for s in (0, 1)) and min(descent[s] - least[s] for s in (0, 1)) > 1


def test_empty(spark):
    df = spark.createDataFrame([], "scene_id long, y int, x int, c0 int, c1 int, c2 int, trimap string, fg_cost double, bg_cost double")
    assert C.cut_labels(df, spark.createDataFrame([], "scene_id long, beta double")).count() == 0


def test_missing_costs_and_colours(spark):
    rows = scenes([(6, 6)], 100, 2)
    df = spark.createDataFrame(rows).withColumns({
        **{c: F.col(c).cast("int") for c in ("y", "x")}, "fg_cost": F.when(F.col("y") != 2, F.col("fg_cost")),
        "c1": F.when(F.col("x") != 3, F.col("c1"))})
    out = C.cut_labels(df, spark.createDataFrame([(0, 0.001)], "scene_id long, beta double"), 1)
    assert out.count() == 36 and out.filter("label IN (0, 255)").count() == 36


def test_outweighed_pixels_are_taken_out_before_the_cut():
    """A chain: a sure end decides its weak neighbour, a tie is background, and a pixel that
    its arcs outweigh is left to the cut."""
    g = C._Grid(np.zeros(5, int), np.arange(5))
    gain = np.array([-30, 4, 5, 9, -1])
    arcs = np.zeros((8, 5), np.int64)
    arcs[4, :4] = arcs[3, 1:] = [10, 2, 5, 20]                  # to the right and to the left
    side, rest, links = C._outweighed(g, gain, np.zeros(5, np.int64), arcs)
    assert side.tolist() == [-1, -1, 0, 0, 0]                   # 4 - 10 + 2 < 0, then 5 - 2 < 5
    assert rest.tolist() == [0, 0, 3, 9, -1]
    assert links[4].tolist() == [0, 0, 5, 20, 0]
    side, rest, links = C._outweighed(g, np.array([-30, 4, 7, 9, -1]), np.zeros(5, np.int64), arcs)
    assert side.tolist() == [-1, -1, 1, 0, 0] and rest.tolist() == [0, 0, 0, 14, -1]   # 7 - 2 = 5: a tie


def test_partitions_of_open_pixels_go_by_their_number(spark):
    """They are few bytes, and a merged partition would take all tiles in one task."""
    frame = spark.range(1).selectExpr("id AS scene_id", "0 AS y", "0 AS x")
    for size, parts in ((1, 1), (C.OPEN_ROWS, 2)):
        plan = C._dealt(frame, 4, (8, 8), size).count()._jdf.queryExecution().toString()
        assert f", {parts}), REPARTITION_BY_NUM" in plan or parts == 1 and "SinglePartition, REPARTITION_BY_NUM" in plan
