"""Mixture segmentation guided by a trimap, smoothing, and mask refinement.

All scenes advance together.  Mixtures are learned from colour counts (scene,
side, colour), which are far fewer rows than pixels; a scene's model is one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tiles as tl
from ..functions.joins import attach
from ..functions.runtime import materialise
from ..schema import PIXEL
from .bands import trimap_label
from .cut import COLOURS, GAMMA, cut_labels
from .masks import contrast_scale, neighbor_pairs
from .neighborhood import erosion_depth

COMPONENTS = 5
# Noise added to a singular covariance (fixed value).
NOISE = 0.01
# Determinant of a singular covariance relative to the product of its variances (fixed value).
SINGULAR = 1e-9
# Effective overlap limit: 5 percent of flags that count 127.5 each (fixed values).
OVERLAP_LIMIT = 5.0 / 127.5



def colour_counts(table: DataFrame, trimap="trimap") -> DataFrame:
    """Pixels per scene, side of the trimap (1 foreground, 0 background) and colour."""
    side = F.when(F.col(trimap).isin("FGD", "PR_FGD"), 1).otherwise(0).alias("side")
    return table.groupBy("scene_id", side, *COLOURS).agg(F.count("*").alias("w"))


def _start(counts: DataFrame) -> DataFrame:
    """First components: quintiles of the colour sum within each side."""
    key = sum((F.col(c).cast("int") for c in COLOURS[1:]), F.col(COLOURS[0]).cast("int"))
    keyed = counts.withColumn("_k", key)
    cuts = [k / COMPONENTS for k in range(1, COMPONENTS)]
    bounds = (keyed.groupBy("scene_id", "side", "_k").agg(F.sum("w").alias("_w"))       # at most 766 per side
              .groupBy("scene_id", "side")
              .agg(F.percentile("_k", F.array(*map(F.lit, cuts)), F.col("_w")).alias("_q")))
    above = sum((F.when(F.col("_k") > F.col("_q")[i], 1).otherwise(0) for i in range(COMPONENTS - 1)), F.lit(0))
    return attach(keyed, bounds, ["scene_id", "side"]).withColumn("component", above).drop("_k", "_q")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(3) for j in range(i, 3)]


def _v(i: int, j: int) -> str:
    return f"v{min(i, j)}{max(i, j)}"


def _minor(i: int, j: int) -> str:
    """Signed cofactor of the symmetric 3×3 covariance."""
    a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    minor = f"({_v(a[0], b[0])} * {_v(a[1], b[1])} - {_v(a[0], b[1])} * {_v(a[1], b[0])})"
    return minor if (i + j) % 2 == 0 else f"(-{minor})"


# Long formulas are SQL text: building them column by column costs the driver
# more time than a round of a small archive takes.
_DETERMINANT = " + ".join(f"{_v(0, j)} * {_minor(0, j)}" for j in range(3))


def learn(assigned: DataFrame) -> DataFrame:
    """Share, mean, covariance inverse and determinant of every component.

    Sums are whole numbers, so they do not depend on row order.
    """
    sums = assigned.groupBy("scene_id", "side", "component").agg(
        F.sum("w").alias("n"),
        *[F.expr(f"sum(w * {c})").alias(f"s{i}") for i, c in enumerate(COLOURS)],
        *[F.expr(f"sum(w * {COLOURS[i]} * {COLOURS[j]})").alias(f"q{i}{j}") for i, j in _pairs()])
    # At most five rows per scene and side.
    moments = sums.selectExpr("*", "double(n) / sum(n) OVER (PARTITION BY scene_id, side) AS share",
                              *[f"s{i} / double(n) AS m{i}" for i in range(3)])
    spread = moments.selectExpr("*", *[f"q{i}{j} / double(n) - m{i} * m{j} AS {_v(i, j)}" for i, j in _pairs()])
    # Singular by its rank: the bound is far above the rounding of the sums.
    flat = spread.selectExpr(
        "*", f"{_DETERMINANT} <= greatest({SINGULAR}D * v00 * v11 * v22, 2.220446049250313E-16D) AS _flat")
    fixed = flat.withColumns({f"v{i}{i}": F.expr(f"v{i}{i} + if(_flat, {NOISE}D, 0D)") for i in range(3)})
    return fixed.selectExpr("*", f"{_DETERMINANT} AS det").selectExpr(
        "scene_id", "side", "component", "n", "share", "m0", "m1", "m2", "det",
        *[f"{_minor(i, j)} / det AS i{i}{j}" for i, j in _pairs()])


_FIELDS = ["share", "m0", "m1", "m2", "det", *[f"i{i}{j}" for i, j in _pairs()]]


def model_rows(components: DataFrame, by_side: bool) -> DataFrame:
    """Components as struct columns of one row per scene (and side)."""
    row = f"struct({', '.join(_FIELDS)})"
    if by_side:
        return components.groupBy("scene_id", "side").agg(
            *[F.expr(f"max(CASE WHEN component = {k} THEN {row} END)").alias(f"k{k}") for k in range(COMPONENTS)])
    return components.groupBy("scene_id").agg(
        *[F.expr(f"max(CASE WHEN side = {s} AND component = {k} THEN {row} END)").alias(f"k{s}{k}")
          for s in (0, 1) for k in range(COMPONENTS)])


def _offset(k: str, i: int) -> str:
    return f"({COLOURS[i]} - {k}.m{i})"


def _density(k: str) -> str:
    """Gaussian density of a component at the row's colour, up to a constant."""
    form = " + ".join(f"{k}.i{i}{j} * {_offset(k, i)} * {_offset(k, j)}" + ("" if i == j else " * 2D") for i, j in _pairs())
    return f"exp(-0.5D * ({form})) / sqrt({k}.det)"


def _closeness(k: str) -> str:
    return "-(" + " + ".join(f"{_offset(k, i)} * {_offset(k, i)}" for i in range(3)) + ")"


def _choose(counts: DataFrame, components: DataFrame, worth) -> DataFrame:
    """Component of the largest worth within a colour's side; the first one wins
    and absent components lose."""
    ks = [f"k{k}" for k in range(COMPONENTS)]
    ranked = ", ".join(f"struct(coalesce({worth(k)}, double('-Infinity')) AS v, {-i} AS i)" for i, k in enumerate(ks))
    return (attach(counts, model_rows(components, True), ["scene_id", "side"], cheap=True)
            .withColumn("component", F.expr(f"-greatest({ranked}).i")).drop(*ks))


def assign(counts: DataFrame, components: DataFrame) -> DataFrame:
    """Most likely component of each colour."""
    return _choose(counts, components, _density)


def _nearest(counts: DataFrame, components: DataFrame) -> DataFrame:
    """Component with the closest mean (one k-means assignment)."""
    return _choose(counts, components, _closeness)


def start_components(counts: DataFrame, kmeans_rounds: int = 10) -> DataFrame:
    """Components of a k-means clustering of each side, from quintiles."""
    components = materialise(learn(_start(counts)))
    for _ in range(kmeans_rounds):
        components = materialise(learn(_nearest(counts, components)))
    return components


def unary_costs(table: DataFrame, components: DataFrame) -> DataFrame:
    """Negative log-likelihood of each pixel under both mixtures."""
    def cost(s: int):
        parts = " + ".join(f"coalesce(k{s}{k}.share * {_density(f'k{s}{k}')}, 0D)" for k in range(COMPONENTS))
        return F.expr(f"-ln(greatest({parts}, 1E-300D))")

    return (attach(table, model_rows(components, False), ["scene_id"], cheap=True)
            .withColumns({"bg_cost": cost(0), "fg_cost": cost(1)})
            .drop(*[f"k{s}{k}" for s in (0, 1) for k in range(COMPONENTS)]))


def label_by_cost(table: DataFrame, trimap="trimap") -> DataFrame:
    """255 where the foreground is likelier; sure pixels keep their side."""
    likelier = F.when(F.col("fg_cost") < F.col("bg_cost"), 255).otherwise(0)
    return table.withColumn("label", F.when(F.col(trimap) == "FGD", 255).when(F.col(trimap) == "BGD", 0)
                            .otherwise(likelier).cast("smallint"))


def gmm_round(table: DataFrame, components: DataFrame, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round: assign colours to components, learn again, cost every pixel."""
    counts = colour_counts(table) if counts is None else counts
    learned = materialise(learn(assign(counts, components)))
    return label_by_cost(unary_costs(table, learned)), learned


def gmm_segment(table: DataFrame, kmeans_rounds: int = 10) -> DataFrame:
    """Segmentation of features ``c0 … c2`` under a ``trimap``: start components,
    one round, and the label with both costs."""
    counts = materialise(colour_counts(table))
    return gmm_round(table, start_components(counts, kmeans_rounds), counts)[0]


def _sweep(part: pd.DataFrame, sweeps: int, bits: int) -> pd.DataFrame:
    """Coordinate descent on one tile.  Pixels whose row and column have equal
    parity are no neighbours of each other, so each of the four parity classes
    is updated at once without raising the energy."""
    y, x = part["y"].to_numpy(), part["x"].to_numpy()
    top, left = y.min() - 1, x.min() - 1
    iy, ix = y - top, x - left
    shape = (iy.max() + 2, ix.max() + 2)

    def grid(values, fill):
        out = np.full(shape, fill, float)
        out[iy, ix] = values
        return out

    colours = np.stack([grid(part[c], np.nan) for c in COLOURS])
    beta = float(part["beta"].iloc[0])
    gain = grid(part["fg_cost"] - part["bg_cost"], 0.0)
    free = grid(~part["trimap"].isin(["FGD", "BGD"]), 0.0) > 0
    spin = grid(np.where(part["label"] > 0, 1.0, -1.0), 0.0)      # 0 outside the image
    steps = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    inner = np.s_[1:-1, 1:-1]

    def moved(a, step):
        return a[..., 1 + step[0]:a.shape[-2] - 1 + step[0], 1 + step[1]:a.shape[-1] - 1 + step[1]]

    weights = []
    for step in steps:
        gap = ((moved(colours, step) - colours[..., 1:-1, 1:-1]) ** 2).sum(0)
        weights.append(np.nan_to_num(GAMMA * np.exp(-beta * gap) / np.hypot(*step)))
    rows, cols = np.indices((shape[0] - 2, shape[1] - 2))
    parity = ((rows + top + 1) % 2) * 2 + (cols + left + 1) % 2
    # Pixels of the rim may go wrong at its edge, so only the tile's own ones tell whether it rests.
    own = grid((y >> bits == part["_ty"].to_numpy()) & (x >> bits == part["_tx"].to_numpy()), 0.0) > 0
    busy = True
    for _ in range(sweeps):
        before = spin.copy()
        for turn in range(4):
            # Cost of foreground minus cost of background at each pixel.
            pull = gain[inner] - sum(w * moved(spin, step) for w, step in zip(weights, steps))
            change = free[inner] & (parity == turn) & (pull != 0)
            spin[inner] = np.where(change, np.where(pull < 0, 1.0, -1.0), spin[inner])
        moved_now = spin != before
        busy = bool(moved_now[own].any())
        if not moved_now.any():
            break
    return part.assign(label=np.where(spin[iy, ix] > 0, 255, 0).astype(np.int16), _busy=busy)


def smooth_labels(costs: DataFrame, beta: DataFrame, sweeps: int = 8, bits: int = 8) -> DataFrame:
    """Lower the Potts energy of the labels until it rests: unary costs plus
    contrast-dependent weights between differing 8-neighbours.

    A sweep carries influence at most four pixels far, so tiles with a rim of
    ``4 · sweeps`` pixels give exactly the result of sweeping whole images.
    Passes of up to ``sweeps`` sweeps go on while a tile of a scene was still
    changing in the last one; scenes at rest take no further part.  The energy
    falls with every change, so all of them rest.
    This finds a local minimum of the energy; :func:`bandscape.operators.cut.cut_labels` finds the least one.
    """
    active, resting = attach(costs, beta, ["scene_id"]), []
    while True:
        tiled = tl.halo_tiles(active, 4 * sweeps, bits)
        schema = T.StructType([*tiled.schema.fields, T.StructField("_busy", T.BooleanType())])
        swept = tiled.groupBy(*tl.TILE).applyInPandas(lambda part: _sweep(part, sweeps, bits), schema)
        swept = materialise(tl.own_pixels(swept, bits))
        busy = materialise(swept.filter("_busy").select("scene_id").distinct())
        swept = swept.drop("_busy")
        if busy.isEmpty():
            return reduce(DataFrame.unionByName, [*resting, swept]).drop("beta")
        resting.append(attach(swept, busy, ["scene_id"], "left_anti"))
        active = attach(swept, busy, ["scene_id"], "left_semi")


def potts_energy(labelled: DataFrame, beta: DataFrame) -> DataFrame:
    """Energy per scene that :func:`smooth_labels` lowers."""
    unary = labelled.groupBy("scene_id").agg(
        F.sum(F.when(F.col("label") > 0, F.col("fg_cost")).otherwise(F.col("bg_cost"))).alias("unary"))
    pairs = attach(neighbor_pairs(labelled, [*COLOURS, "label"]), beta, ["scene_id"])
    gap = sum(((F.col(c) - F.col(f"{c}_n")).cast("double") * (F.col(c) - F.col(f"{c}_n")) for c in COLOURS), F.lit(0.0))
    length = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    cost = GAMMA * F.exp(-F.col("beta") * gap) / length
    pairwise = pairs.groupBy("scene_id").agg(
        F.sum(F.when(F.col("label") != F.col("label_n"), cost).otherwise(0.0)).alias("pairwise"))
    return unary.join(pairwise, "scene_id", "left").select(
        "scene_id", (F.col("unary") + F.coalesce("pairwise", F.lit(0.0))).alias("energy"))


def stroke_violations(table: DataFrame, limit: float = OVERLAP_LIMIT, erosions: int = 100,
                      base="base") -> DataFrame:
    """Per scene: the number of ``erosions`` after which at most a small share of
    the ``base`` mask is still covered, and how many pixels outside of that mask
    (``violations``) are left then.

    ``table`` has the erosion ``depth`` of every pixel; a histogram of depths
    answers every number of erosions at once.
    """
    on_base = F.col(base) > 0
    counted = table.groupBy("scene_id", F.greatest("depth", F.lit(0)).alias("depth")).agg(
        F.count("*").alias("n"), F.count_if(on_base).alias("hit"))
    # Depth 1 always takes part: it stands for the first erosion.
    first = counted.select("scene_id").distinct().select(
        "scene_id", F.lit(1).alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "hit")])
    steps = (counted.unionByName(first).groupBy("scene_id", "depth")
             .agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")))
    # At most erosions + 2 rows per scene.
    upto, whole = Window.partitionBy("scene_id").orderBy("depth"), Window.partitionBy("scene_id")
    positive = F.sum("hit").over(whole)
    left = {f"left_{c}": F.sum(c).over(whole) - F.sum(c).over(upto) for c in ("n", "hit")}
    curve = steps.withColumns({**left, "positive": positive})
    stop = (F.col("left_n") == 0) | (F.col("left_hit") / F.when(F.col("positive") > 0, F.col("positive")) < limit)
    usable = F.col("depth").between(1, erosions)
    at_end = F.struct("depth", (F.col("left_n") - F.col("left_hit")).alias("violations"))
    return (curve.filter(usable).groupBy("scene_id")
            .agg(F.coalesce(F.min(F.when(stop, at_end)), F.max(at_end)).alias("_end"),
                 F.min(F.when(stop, F.col("depth"))).alias("_stop"))
            .select("scene_id", F.coalesce("_stop", F.lit(erosions)).alias("erosions"), "_end.violations"))


def refine_round(table: DataFrame, limit: float = OVERLAP_LIMIT, erosions: int = 100, base="base",
                 bits: int | None = None) -> DataFrame:
    """Mark ``violation`` pixels: those left of the mask ``label`` after eroding it
    until at most a small share of the ``base`` mask is covered, yet outside of it."""
    deep = materialise(erosion_depth(table, erosions + 1, bits=bits))
    return _marked(deep, stroke_violations(deep, limit, erosions, base), base).drop("depth", "violations")


def _marked(deep: DataFrame, ends: DataFrame, base="base") -> DataFrame:
    return attach(deep, ends, ["scene_id"]).withColumn(
        "violation", (F.col("depth") > F.col("erosions")) & (F.col(base) == 0))


def _segment(table: DataFrame, components: DataFrame, beta: DataFrame,
             counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    costs, learned = gmm_round(table.drop("label"), components, counts)
    smoothed = cut_labels(costs, beta).drop("bg_cost", "fg_cost")
    settled = F.when(F.col("trimap").isin("FGD", "BGD"), F.col("trimap")).when(
        F.col("label") > 0, "PR_FGD").otherwise("PR_BGD")
    return materialise(smoothed.withColumn("trimap", settled)), learned


def refine(table: DataFrame, limit: float = OVERLAP_LIMIT, rounds: int = 100, erosions: int = 100,
           kmeans_rounds: int = 10, preset="score") -> DataFrame:
    """Segment, then refine until no pixel violates the stroke criterion.

    ``table``: scene_id, y, x, c0, c1, c2, score, base (the mask).  A scene leaves
    the loop once it has no violations; one last round follows.  Returns the
    table with ``label`` and ``settled``, false for scenes that still had
    violations when the rounds ran out.
    """
    columns = [*PIXEL, *COLOURS, "score", "base"]
    guide = trimap_label(F.col("score"), F.col("base"), preset)
    table = materialise(table.select(*columns).withColumn("trimap", guide))
    beta = materialise(contrast_scale(table))
    counts = materialise(colour_counts(table))
    active, components = _segment(table, start_components(counts, kmeans_rounds), beta, counts)
    finished, late = [], None
    for _ in range(rounds):
        deep = materialise(erosion_depth(active, erosions + 1))
        ends = materialise(stroke_violations(deep, limit, erosions))
        if ends.filter("violations > 0").isEmpty():
            break
        marked = _marked(deep, ends)
        finished.append(marked.filter("violations = 0").select(*active.columns))
        again = (marked.filter("violations > 0")
                 .withColumn("score", F.when(F.col("violation"), 0.0).otherwise(F.col("score")))
                 .withColumn("trimap", guide).select(*active.columns))
        active, learned = _segment(again, components, beta)
        # Scenes outside of this round keep their last model.
        left = attach(components, learned.select("scene_id").distinct(), ["scene_id"], "left_anti")
        components = materialise(left.unionByName(learned))
        late = ends.filter("violations > 0").select("scene_id")
    else:
        rounds = None
    for part in finished:
        active = active.unionByName(part)
    labelled = _segment(active, components, beta)[0].select(*columns, "trimap", "label")
    if rounds is not None or late is None:
        return labelled.withColumn("settled", F.lit(True))
    return attach(labelled, late.withColumn("settled", F.lit(False)), ["scene_id"]).withColumn(
        "settled", F.coalesce("settled", F.lit(True)))
