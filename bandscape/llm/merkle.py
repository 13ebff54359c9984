"""Merkle manifest of a dataset: digests, proofs and their verification.

A tree for each group of rows (a source) has runs of three nodes under each node;
the groups' roots are the leaves of one more tree.  Trees are cut into superblocks
of ``BLOCK`` consecutive nodes, each a whole subtree of ``HEIGHT`` levels.

Upwards, every superblock is reduced to its top in one group, and the tops are the
nodes of the next, ``BLOCK`` times smaller table.  Downwards, the nodes of a
superblock are cogrouped with the outer nodes that its proofs need, a row a level;
the group finishes the local reduction, joins local and outer siblings, and hands
them to the superblocks below, or folds the leaves to the root.  No group holds
more than ``BLOCK`` nodes and one row for each level, however large a source is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import materialise
from .common import positions

ARITY = 3
HEIGHT = 6
BLOCK = ARITY ** HEIGHT         # nodes a superblock

_OUTER = "tree string, block bigint, level int, among boolean, left string, right string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values, each as byte count, colon and text, or ``-`` if it is null."""
    texts = [value.cast("string") for value in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def climb(nodes: list[str], whole: bool) -> list[list[str]]:
    """Levels above ``nodes``: up to a single node if they are a whole tree, else
    ``HEIGHT`` levels, in which a last run of one node is hashed as well."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= HEIGHT:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of the node's own path, level by level."""
    for level in levels[:-1]:
        run = at - at % ARITY
        yield "".join(level[run:at]), "".join(level[at + 1:run + ARITY])
        at //= ARITY


def fold(node: str, sides: list[tuple[str, str]]) -> str:
    for left, right in sides:
        node = digest(left + node + right)
    return node


def _levels(part: pd.DataFrame) -> list[list[str]]:
    return climb(part["digest"].tolist(), int(part["total"].iloc[0]) <= BLOCK)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos DIV {BLOCK}"))


def _top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    levels = _levels(part.sort_values("pos"))
    return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "total": [-(-int(part["total"].iloc[0]) // BLOCK)],
                         "digest": levels[-1]})


def grow(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, total, digest) and the tops of superblocks above them,
    table by table, up to one root for each tree."""
    tables = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        tops = _blocks(tables[-1].select("tree", "pos", "total", "digest")).groupBy("tree", "block").applyInPandas(
            _top, "tree string, pos bigint, total bigint, digest string")
        tables.append(materialise(tops))
        most = -(-most // BLOCK)
    return tables


def _descend(nodes: DataFrame, outer: DataFrame, among: bool) -> DataFrame:
    """Outer rows for what lies below each node: the siblings on its path to the root."""
    def push(key: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, above = part.sort_values("pos"), above.sort_values("level")
        levels = _levels(part) if len(part) else [[]]
        upper = list(zip(above["among"], above["left"], above["right"]))
        rows = [(key[0], pos, level, *row) for i, pos in enumerate(part["pos"])
                for level, row in enumerate([*((among, *side) for side in siblings(levels, i)), *upper])]
        return pd.DataFrame(rows, columns=["tree", "block", "level", "among", "left", "right"])

    return _cogrouped(_blocks(nodes.select("tree", "pos", "total", "digest")), outer).applyInPandas(push, _OUTER)


def _cogrouped(nodes: DataFrame, outer: DataFrame):
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))


def _paths(tables: list[DataFrame], outer: DataFrame, among: bool) -> DataFrame:
    """Outer rows for the superblocks of the lowest table."""
    for nodes in reversed(tables[1:-1]):
        outer = materialise(_descend(nodes, outer, among))
    return outer


def manifest(leaves: DataFrame, key: str) -> DataFrame:
    """Prove and verify every leaf: (key, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``leaves`` has ``group`` (may be null), ``key``, ``leaf`` and ``claimed``, the
    digest to be verified (null: the leaf itself).  Leaves of a group are ordered by
    key (null first), then by leaf; groups by name (null first).  Repeated rows
    are leaves of their own.  A table of one row has its leaf as root and an empty
    proof.  ``verified`` tells whether the claimed digest folds to the root.
    An empty table gives no rows.
    """
    # A null group sorts before all others, also before the empty name.
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    rows = materialise(leaves.select(tree.alias("tree"), F.col(key).alias("key"), F.col("leaf").alias("digest"),
                                     "claimed", F.monotonically_increasing_id().alias("row")))
    nodes = positions(rows, ["tree"], ["key", "digest", "row"], "pos", "total")
    below = grow(nodes)
    roots = materialise(below[-1].select(F.lit(0).alias("all"), F.col("tree").alias("name"), "digest"))
    roots = positions(roots, ["all"], ["name"], "pos", "total").select(
        F.lit("").alias("tree"), "name", "pos", "total", "digest")
    above = grow(roots)
    root = above[-1].select("digest").first()               # a single row
    root = root.digest if root else ""
    none = leaves.sparkSession.createDataFrame([], _OUTER)
    outer = none
    if len(above) > 1:
        outer = materialise(_descend(roots, _paths(above, none, True), True))
        outer = materialise(outer.join(roots.select(F.col("pos").alias("block"), "name"), "block").select(
            F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"), "level", "among", "left", "right"))
    outer = _paths(below, outer, False)

    def settle(_: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, above = part.sort_values("pos"), above.sort_values("level")
        levels = _levels(part) if len(part) else [[]]
        upper = list(zip(above["left"], above["right"]))
        inside = [side for side, other in zip(upper, above["among"]) if not other]
        joined = "".join(left + right for left, right in upper)
        proofs, folded = [], []
        for i, claimed in enumerate(part["claimed"]):
            local = list(siblings(levels, i))
            proofs.append(digest("".join(left + right for left, right in local) + joined))
            folded.append(fold(claimed, local + upper))
        subroot = fold(levels[-1][0], inside) if len(part) else ""
        return pd.DataFrame({"key": part["key"], "leaf": part["digest"], "subroot": subroot, "root": root,
                             "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    schema = (f"key {leaves.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, "
              "proof_sha256 string, folded_root string, verified boolean")
    claimed = F.coalesce("claimed", "digest").alias("claimed")
    settled = _cogrouped(_blocks(nodes.select("tree", "pos", "total", "key", "digest", claimed)), outer)
    return settled.applyInPandas(settle, schema).withColumnRenamed("key", key)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents by source.  Where ``tampered`` holds, the claimed leaf is
    that of the text without its line feeds; a null text stays null."""
    def leaf(text: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    changed = F.replace("text", F.lit("\n"), F.lit(""))
    return docs.select(F.col("source").alias("group"), "doc_id", leaf(F.col("text")).alias("leaf"),
                       F.when(tampered & (F.instr("text", "\n") > 0), leaf(changed)).alias("claimed"))
