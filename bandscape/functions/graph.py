"""Connected parts of undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node reachable over undirected ``edges``.

    Nodes are numbers, or structs of them.  Large-star and small-star steps
    alternate until the edges rest, which takes about log(nodes) rounds, chains
    included.  Neighbour minima are aggregates joined back, so a node with very
    many neighbours is never gathered.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    pairs = materialise(pairs)
    state = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("m as u", "v").filter("u < v").distinct()
        large = materialise(large)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.selectExpr("m as u", "u as v").union(joined.selectExpr("m as u", "v")).filter("u < v").distinct()
        pairs = materialise(small)
        before, state = state, _digest(pairs)
        if state == before:
            break
    return pairs.groupBy("v").agg(F.min("u").alias("label")).withColumnRenamed("v", "node").unionByName(
        pairs.selectExpr("u as node", "u as label").distinct())


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
