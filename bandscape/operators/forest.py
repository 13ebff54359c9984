"""A random forest for each scene, all grown at once, a level at a time.

A tree sees a scene's sample with whole weights drawn from a hash, so results are
repeatable.  In each level one aggregate counts the classes for every (scene, tree,
node, band, value); running sums over a band's values weigh every split of every
node, and the rows move on to the children.  Nothing loops over scenes or trees.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as tl
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL, band_columns
from .bands import with_mask
from .masks import balanced_sample

# Depth and least rows of a node, and shares of a sample's rows that a tree sees
# up to 0, 1, ... times: the Poisson distribution of mean 1 (fixed values).
DEPTH, LEAST = 7, 50
SHARES = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917]

NODE = ["scene_id", "tree", "node"]


def draws(seed: int) -> Column:
    """How often a tree sees a row: 0 to 7 times, by a hash of scene, place, tree and seed."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*PIXEL, "tree"]], F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return sum((F.when(number >= int(share * 2 ** 32), 1).otherwise(0) for share in SHARES), F.lit(0))


def bootstrap(sample: DataFrame, trees: int, seed: int) -> DataFrame:
    """(scene_id, tree, node, v, hit, w): the rows that each tree sees, at its root.

    ``sample`` has pixels, bands and ``label`` (255 is the class that counts as hit);
    rows without all bands take no part.
    """
    bands = band_columns(sample)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in bands])
    seen = (sample.filter(whole).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
            .withColumn("w", draws(seed)).filter("w > 0"))
    return seen.select("scene_id", "tree", F.lit(1).alias("node"), F.array(*[F.col(c).cast("double") for c in bands]).alias("v"),
                       F.when(F.col("label") == 255, F.col("w")).otherwise(0).alias("hit"), "w")


def value_counts(rows: DataFrame) -> DataFrame:
    """(scene_id, tree, node, band, value, n, hits), bands from 1."""
    return (rows.select(*NODE, "hit", "w", F.posexplode("v").alias("band", "value"))
            .groupBy(*NODE, (F.col("band") + 1).alias("band"), "value").agg(F.sum("w").alias("n"), F.sum("hit").alias("hits")))


def _purity(n: str, hits: str) -> str:
    return f"(double({hits}) * {hits} + double({n} - {hits}) * ({n} - {hits})) / {n}"


def best_splits(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Every node with its counts (n, hits) and best split: rows with at most ``value`` in
    ``band`` go left.

    The split with the least Gini impurity among those that leave ``least`` rows on
    both sides; ties go to the smaller band, then the smaller value.  ``band`` is
    null where no such split lowers the impurity.
    """
    line = Window.partitionBy(*NODE, "band")                # at most as many rows as a scene's sample has values
    sums = counts.withColumns({"_l": F.sum("n").over(line.orderBy("value")), "_h": F.sum("hits").over(line.orderBy("value")),
                               "_n": F.sum("n").over(line), "_t": F.sum("hits").over(line)})
    scored = sums.withColumn("_gain", F.expr(
        f"CASE WHEN _l >= {least} AND _n - _l >= {least} THEN {_purity('_l', '_h')} + {_purity('(_n - _l)', '(_t - _h)')} "
        f"- {_purity('_n', '_t')} END"))
    best = F.min(F.when(F.col("_gain") > 1e-9, F.struct((-F.round("_gain", 9)).alias("g"), "band", "value")))
    return (scored.groupBy(*NODE).agg(F.max("_n").alias("n"), F.max("_t").alias("hits"), best.alias("_b"))
            .select(*NODE, "n", "hits", "_b.band", "_b.value"))


def grow(rows: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """Nodes of all trees: (scene_id, tree, node, n, hits, band, value), leaves without a band.

    Node 1 is a root; the children of node k are 2 k and 2 k + 1.
    """
    rows, levels = materialise(rows), []
    for level in range(depth + 1):
        nodes = materialise(best_splits(value_counts(rows), least))
        if level == depth:
            none = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in ("band", "value")}
            return reduce(DataFrame.unionByName, [*levels, nodes.withColumns(none)])
        levels.append(nodes)
        splits = nodes.filter("band IS NOT NULL").select(*NODE, "band", "value")
        if splits.isEmpty():
            break
        right = (F.element_at("v", F.col("band")) > F.col("value")).cast("int")
        rows = materialise(attach(rows, splits, NODE, "inner").withColumn("node", 2 * F.col("node") + right).drop("band", "value"))
    return reduce(DataFrame.unionByName, levels)


def _vote(values: np.ndarray, model: pd.DataFrame) -> np.ndarray:
    """Mean share of hits over all trees for every row of ``values``."""
    trees = np.unique(model["tree"])
    size = int(model["node"].max()) + 1
    at = np.searchsorted(trees, model["tree"]), model["node"].to_numpy()
    band, value, share = np.zeros((len(trees), size), int), np.zeros((len(trees), size)), np.zeros((len(trees), size))
    band[at] = model["band"].fillna(0).astype(int)
    value[at] = model["value"].fillna(0)
    share[at] = model["hits"] / model["n"]
    total, row = np.zeros(len(values)), np.arange(len(values))
    for b, v, s in zip(band, value, share):
        node = np.ones(len(values), int)
        while (inner := b[node] > 0).any():
            right = values[row, np.maximum(b[node] - 1, 0)] > v[node]
            node = np.where(inner, 2 * node + right, node)
        total += s[node]
    return total / len(trees)


def scene_forests(signal: DataFrame, mask: DataFrame | None = None, n: int = 1000, trees: int = 50, seed: int = 7,
                  bits: int = 8) -> DataFrame:
    """(scene_id, y, x, score, probability) by a forest of the pixel's own scene.

    A scene's forest learns from up to ``n`` evenly spaced pixels of each class.  The
    score is the class of the larger mean share (background on a tie).  Pixels without
    all bands, and scenes that lack a class, keep their rows without a score.  A
    scene with too few pixels for a split has the share of its sample everywhere.
    """
    table = signal if mask is None else materialise(with_mask(signal, mask))        # read to learn and to score
    bands = band_columns(table)
    model = materialise(grow(bootstrap(balanced_sample(table, n), trees, seed)))
    pixels = table.select(*PIXEL, *bands).withColumns({f"_t{c}": F.shiftright(c, bits) for c in "yx"})
    # A tile meets its scene's nodes: at most 2 n / LEAST leaves a tree.
    dealt = materialise(pixels.select(*tl.TILE).distinct()).join(model, "scene_id")
    schema = f"scene_id {table.schema['scene_id'].dataType.simpleString()}, y int, x int, score double, probability double"

    def score(key: tuple, part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        values = part[bands].to_numpy(float, na_value=np.nan)
        known = np.isfinite(values).all(1) & (len(nodes) > 0)
        chance = np.full(len(part), np.nan)
        if known.any():
            chance[known] = _vote(values[known], nodes)
        hard = pd.arrays.FloatingArray(np.where(chance > 0.5, 1.0, 0.0), ~known)
        return part[PIXEL].assign(score=hard, probability=pd.arrays.FloatingArray(np.nan_to_num(chance), ~known))

    return pixels.groupBy(*tl.TILE).cogroup(dealt.groupBy(*tl.TILE)).applyInPandas(score, schema)
