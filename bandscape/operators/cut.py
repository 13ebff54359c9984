"""Labels of the least Potts energy: an exact minimum cut over tiles.

The cut is found in whole numbers: costs and weights are rounded to ``1 / SCALE``.

First, every tile is cut twice, with all pixels around it taken as background and
as foreground, after the pixels whose cost outweighs all their arcs have been given
their label.  The energy is submodular, so a pixel that has the same label both
times has it in the least cut of the whole scene as well.  It goes, and its pull
on undecided neighbours becomes part of their costs.  Only undecided pixels take
part in the next round, in tiles shifted by half an edge, so the work shrinks to
where labels are still open.  A scene within one tile is done at once.

What stays open after that is cut by push-relabel.  Each round deals the open
pixels to tiles; a task pushes excess and raises labels of a tile's inner pixels,
while those with an arc out of the tile keep their label.  Four tilings take
turns, and every arc lies inside of at least one.  Each pixel is in one task per
round, so no two tasks touch the same arc.  Between rounds of pushing, distances
to the sink are found anew from above, so parts that cannot reach it rest at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tiles as tl
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL

SCALE = 1 << 16
# Weight of the smoothness term (fixed value).
GAMMA = 50.0
# A cost that no neighbours outweigh: their weights add up to less than 7 GAMMA.
SURE = int(8 * GAMMA * SCALE)
COLOURS = ["c0", "c1", "c2"]

_STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]     # step i is opposite to 7 - i
_FAR = 1 << 30
# Open pixels for each partition: they lie in up to as many tiles, at some milliseconds a tile.
OPEN_ROWS = 500


class _Grid:
    """Pixels of a tile in a flat image with an empty rim."""

    def __init__(self, y: np.ndarray, x: np.ndarray) -> None:
        top, left = y.min() - 1, x.min() - 1
        width = int(x.max() - left + 2)
        self.size = int(y.max() - top + 2) * width
        self.at = (y - top).astype(np.int64) * width + (x - left)
        self.steps = [dy * width + dx for dy, dx in _STEPS]
        self.here = np.zeros(self.size, bool)
        self.here[self.at] = True

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((*values.shape[:-1], self.size), values.dtype)
        out[..., self.at] = values
        return out

    def beside(self) -> np.ndarray:
        """For each step and pixel: is there a pixel?"""
        return np.stack([self.here[self.at + s] for s in self.steps])


def _outside(y: np.ndarray, x: np.ndarray, tile: tuple[int, int], bits: int, shift: tuple[int, int]) -> np.ndarray:
    """For each step and pixel: does the step leave the tile?"""
    return np.stack([((y + dy + shift[0]) >> bits != tile[0]) | ((x + dx + shift[1]) >> bits != tile[1]) for dy, dx in _STEPS])


def _distances(g: _Grid, sink: np.ndarray, arcs: np.ndarray, far: np.ndarray) -> dict[int, np.ndarray]:
    """Lower the distances ``far`` to those over the open ``arcs`` to the sink, or to a pixel
    that has a distance already.  Returns the pixels that got each distance."""
    front = np.flatnonzero((sink > 0) & (far > 1))
    far[front] = 1
    given = np.flatnonzero(far < _FAR)
    given = given[np.argsort(far[given], kind="stable")]
    labels, used, k, levels = far[given], 0, 1, {}
    begun = np.zeros(g.size, bool)
    begun[front] = True
    while len(front) or used < len(given):
        if not len(front):
            k = max(k, int(labels[used]))
        upto = int(np.searchsorted(labels, k, "right"))
        some = given[used:upto]
        used = upto
        some = some[(far[some] == k) & ~begun[some]]
        levels[k] = front
        source, found = np.concatenate([front, some]), []
        for i, step in enumerate(g.steps):
            q = source - step
            q = q[(arcs[i][q] > 0) & (far[q] > k + 1)]
            far[q] = k + 1
            begun[q] = True
            found.append(q)
        front = np.concatenate(found)
        k += 1
    return levels


def _wave(g: _Grid, excess: np.ndarray, sink: np.ndarray, arcs: np.ndarray, far: np.ndarray,
          levels: dict[int, np.ndarray], inner: np.ndarray) -> None:
    """Push all excess of inner pixels towards the sink, from the farthest on."""
    for k in sorted(levels, reverse=True):
        p = levels[k]
        p = p[(excess[p] > 0) & inner[p]]
        if k == 1:
            amount = np.minimum(excess[p], sink[p])
            excess[p] -= amount
            sink[p] -= amount
        for i, step in enumerate(g.steps if k > 1 else ()):
            if not len(p):
                break
            open_ = (arcs[i][p] > 0) & (far[p + step] == k - 1)
            at = p[open_]
            amount = np.minimum(excess[at], arcs[i][at])
            excess[at] -= amount
            arcs[i][at] -= amount
            excess[at + step] += amount
            arcs[7 - i][at + step] += amount
            p = p[excess[p] > 0]


def _drain(g: _Grid, excess: np.ndarray, sink: np.ndarray, arcs: np.ndarray, inner: np.ndarray,
           given: np.ndarray) -> np.ndarray:
    """Push until no inner pixel with excess can reach the sink or a pixel of ``given`` distance."""
    while True:
        far = given.copy()
        levels = _distances(g, sink, arcs, far)
        if not ((excess > 0) & (far < _FAR) & inner).any():
            return far
        _wave(g, excess, sink, arcs, far, levels, inner)


def _closed_cut(g: _Grid, gain: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Foreground of the least cut of the tile alone; of several, the one with the least foreground."""
    excess, sink = g.spread(np.maximum(gain, 0)), g.spread(np.maximum(-gain, 0))
    far = _drain(g, excess, sink, g.spread(arcs), g.here, np.full(g.size, _FAR))
    return far[g.at] < _FAR


def _outweighed(g: _Grid, gain: np.ndarray, pull: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels whose cost outweighs all arcs, whatever lies at their ends (1: background, -1: foreground,
    0: left to the cut), and the costs and arcs of the other pixels without them."""
    side, gain, arcs = np.zeros(len(gain), np.int64), gain.copy(), arcs.copy()
    while True:
        total = pull + arcs.sum(0)
        found = np.where(side != 0, 0, np.where(gain >= total, 1, np.where(-gain > total, -1, 0)))
        if not found.any():
            return side, gain, arcs
        side += found
        spread = g.spread(found)
        beside = np.stack([spread[g.at + s] for s in g.steps])
        gain += (arcs * beside).sum(0)
        gain[side != 0] = 0
        arcs[beside != 0] = 0
        arcs[:, found != 0] = 0


def _decide(y: np.ndarray, x: np.ndarray, gain: np.ndarray, arcs: np.ndarray, tile: tuple[int, int], bits: int,
            shift: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels that hold whatever lies around the tile (-1: open), costs and arcs
    that are left, and which pixels are still needed: open ones, and decided ones
    with an arc out of the tile."""
    g = _Grid(y, x)
    out = np.where(_outside(y, x, tile, bits, shift), arcs, 0)
    within = np.where(g.beside(), arcs, 0)
    pull = out.sum(0)
    plain, rest, links = _outweighed(g, gain, pull, within)
    low = _closed_cut(g, rest + pull * (plain == 0), links) | (plain < 0)
    high = _closed_cut(g, rest - pull * (plain == 0), links) | (plain < 0) if pull[plain == 0].any() else low
    label = np.where(low == high, np.where(low, 255, 0), -1)
    # The arcs of a decided pixel within the tile become costs of the other end.
    side = g.spread(np.where(label < 0, 0, np.where(label > 0, -1, 1)))
    beside = np.stack([side[g.at + s] for s in g.steps])
    folded = gain + (within * beside).sum(0)
    gain = np.where(label < 0, folded, np.where(label > 0, -SURE, SURE))
    arcs = out + np.where((beside == 0) & (label < 0), within, 0)
    return label, gain, arcs, (label < 0) | (out.sum(0) > 0)


def _start(part: pd.DataFrame, tile: tuple[int, int], bits: int) -> pd.DataFrame:
    """Costs and weights of a tile's own pixels, and what they decide."""
    y, x = part["y"].to_numpy(), part["x"].to_numpy()
    g = _Grid(y, x)
    colours = g.spread(part[COLOURS].to_numpy(float, na_value=np.nan).T)
    mine = (y >> bits == tile[0]) & (x >> bits == tile[1])
    own, at = part[mine], g.at[mine]
    if own.empty:                                           # the rim of its neighbours is all there is
        return _rows(own, np.zeros(0, int), np.zeros(0, int), np.zeros((8, 0), int), np.zeros(0, bool))
    beta = float(part["beta"].iloc[0])
    weights = []
    for (dy, dx), step in zip(_STEPS, g.steps):
        gap = ((colours[:, at + step] - colours[:, at]) ** 2).sum(0)
        weight = np.nan_to_num(GAMMA * SCALE * np.exp(-beta * gap) / np.hypot(dy, dx))
        weights.append(np.where(g.here[at + step], np.rint(weight), 0).astype(np.int64))
    gain = np.nan_to_num((own["fg_cost"] - own["bg_cost"]).to_numpy(float, na_value=np.nan))
    gain = np.rint(np.clip(gain * SCALE, -SURE, SURE)).astype(np.int64)
    gain = np.where(own["trimap"] == "FGD", -SURE, np.where(own["trimap"] == "BGD", SURE, gain))
    label, gain, arcs, needed = _decide(y[mine], x[mine], gain, np.stack(weights), tile, bits, (0, 0))
    return _rows(own, label, gain, arcs, needed)


def _rows(part: pd.DataFrame, label, gain, arcs, needed) -> pd.DataFrame:
    return part.assign(label=pd.arrays.IntegerArray(np.maximum(label, 0).astype(np.int16), label < 0),
                       _gain=gain, _arcs=pd.Series([a if n else None for a, n in zip(arcs.T, needed)], part.index, object))


_OPEN = [T.StructField("_gain", T.LongType()), T.StructField("_arcs", T.ArrayType(T.LongType()))]


def _dealt(rows: DataFrame, bits: int, shift: tuple[int, int], size: int):
    """Rows by the tiles of a shifted tiling.  Open pixels are few bytes in many tiles, so
    the number of partitions goes by their number ``size``."""
    tiles = {f"_t{c}": F.shiftright(F.col(c) + s, bits) for c, s in zip("yx", shift)}
    return tl.to_tiles(rows.withColumns(tiles), 1 + size // OPEN_ROWS).groupBy(*tl.TILE)


def _tilings(bits: int) -> list[tuple[int, int]]:
    half = 1 << bits >> 1
    return [(half, half), (0, half), (half, 0), (0, 0)]


def cut_labels(costs: DataFrame, beta: DataFrame, bits: int = 8) -> DataFrame:
    """``costs`` with the ``label`` (255 or 0) of the least energy: the cost of each
    pixel's label plus contrast-dependent weights between differing 8-neighbours.

    ``costs`` has pixels, colours, ``trimap``, ``fg_cost`` and ``bg_cost``; pixels that
    are surely on a side keep it.  Of several least cuts the result is the one with
    the least foreground.  A pixel without costs follows its neighbours; one
    without a colour has no weights.  Results don't depend on ``bits``, the tile's edge.
    """
    columns = [c for c in costs.columns if c != "label"]
    tiled = tl.halo_tiles(attach(costs.select(*columns), beta, ["scene_id"]), 1, bits)
    kept = [tiled.schema[c] for c in columns]
    schema = T.StructType([*kept, T.StructField("label", T.ShortType()), *_OPEN])
    names = schema.names
    first = materialise(tiled.groupBy(*tl.TILE).applyInPandas(
        lambda key, part: _start(part, key[1:], bits)[names], schema))
    needed = first.filter("_arcs IS NOT NULL").select(*PIXEL, F.col("label").isNotNull().alias("known"), "_gain", "_arcs")
    result = first.filter("label IS NOT NULL").select(*columns, "label")
    if needed.filter("NOT known").isEmpty():
        return result
    late = first.filter("label IS NULL").select(*columns).join(materialise(_open_labels(needed, bits)), PIXEL)
    return result.unionByName(late)


def _open_labels(needed: DataFrame, bits: int) -> DataFrame:
    """Labels of the pixels that are not known yet."""
    schema = T.StructType([needed.schema[c] for c in [*PIXEL, "known"]] + [T.StructField("label", T.ShortType()), *_OPEN])
    names, done = schema.names, []
    size, before = needed.filter("NOT known").count(), None
    # Tiles go on deciding while they halve the open pixels in a turn of all tilings.
    while size and (before is None or 2 * size < before):
        before = size
        for shift in _tilings(bits):
            def step(key, part):
                label, gain, arcs, still = _decide(part["y"].to_numpy(), part["x"].to_numpy(), part["_gain"].to_numpy(),
                                                   np.stack(part["_arcs"]).T, key[1:], bits, shift)
                return _rows(part, label, gain, arcs, still)[names]

            rows = materialise(_dealt(needed, bits, shift, size).applyInPandas(step, schema))     # runs before shift changes
            done.append(rows.filter("label IS NOT NULL AND NOT known").select(*PIXEL, "label"))
            needed = rows.filter("_arcs IS NOT NULL").select(
                *PIXEL, F.col("label").isNotNull().alias("known"), "_gain", "_arcs")
            size = needed.filter("NOT known").count()
            if not size:
                break
    if size:
        done.append(_pushed(needed, bits, size))
    return reduce(DataFrame.unionByName, done)


def _turn(part: pd.DataFrame, tile: tuple[int, int], bits: int, shift: tuple[int, int], push: bool) -> pd.DataFrame:
    """Push the excess of a tile's inner pixels, or lower the tile's distances."""
    y, x, old = (part[c].to_numpy() for c in ("y", "x", "far"))
    g, arcs = _Grid(y, x), np.stack(part["_arcs"]).T
    out = np.where(_outside(y, x, tile, bits, shift), arcs, 0)
    within = g.spread(np.where(g.beside(), arcs, 0))
    excess, sink = (g.spread(part[c].to_numpy()) for c in ("excess", "sink"))
    far = np.full(g.size, _FAR)
    if push:
        rim = (out > 0).any(0)
        far[g.at[rim]] = old[rim]
        inner = g.here.copy()
        inner[g.at[rim]] = False
        far = _drain(g, excess, sink, within, inner, far)
    else:
        far[g.at] = old
        _distances(g, sink, within, far)
    return part.assign(excess=excess[g.at], sink=sink[g.at], _arcs=list((within[:, g.at] + out).T),
                       far=far[g.at].astype(np.int32), moved=far[g.at] != old)


def _pushed(needed: DataFrame, bits: int, size: int) -> DataFrame:
    """Labels of the ``size`` open pixels by push-relabel over alternating tilings."""
    bits = max(bits, 2)                                     # smaller tiles have no inner pixels
    none = F.lit(_FAR)
    state = needed.select(*PIXEL, "known", F.greatest("_gain", F.lit(0)).alias("excess"),
                          F.greatest(-F.col("_gain"), F.lit(0)).alias("sink"), "_arcs", none.alias("far"),
                          F.lit(False).alias("moved"))
    schema, tilings, done = state.schema, _tilings(bits), []
    names = schema.names

    def round_(state: DataFrame, shift: tuple[int, int], push: bool) -> DataFrame:
        return materialise(_dealt(state, bits, shift, size).applyInPandas(
            lambda key, part: _turn(part, key[1:], bits, shift, push)[names], schema))

    while True:
        state, still = state.withColumn("far", none), 0
        for turn in range(1 << 30):                         # until a turn of all tilings changes no distance
            state = round_(state, tilings[turn % 4], False)
            still = 0 if not state.filter("moved").isEmpty() else still + 1
            if still == 4:
                break
        # What cannot reach the sink is background, as no later push can change that.
        done.append(state.filter(F.col("far") >= none).withColumn("label", F.lit(0)))
        reaching = state.filter(F.col("far") < none)
        busy = materialise(reaching.filter("excess > 0").select("scene_id").distinct())
        done.append(attach(reaching, busy, ["scene_id"], "left_anti").withColumn("label", F.lit(255)))
        if busy.isEmpty():
            return reduce(DataFrame.unionByName, [
                part.filter("NOT known").select(*PIXEL, F.col("label").cast("smallint").alias("label")) for part in done])
        state = attach(reaching, busy, ["scene_id"], "left_semi")
        for shift in tilings:
            state = round_(state, shift, True)
