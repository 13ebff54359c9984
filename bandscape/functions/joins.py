"""Joins and ranks that stay even when one scene holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import is_written, materialise

# Settings: most group rows, and most bytes of them, that are sent to every
# executor; the number of slices a group is cut
# into beyond that, and most group rows that are copied per slice; beyond that,
# the share 1/n of all rows from which a key counts as hot.
BROADCAST_ROWS = "spark.bandscape.broadcast.maxRows"
BROADCAST_BYTES = "spark.bandscape.broadcast.maxBytes"
SALT_SLICES = "spark.bandscape.salt.slices"
SALT_ROWS = "spark.bandscape.salt.maxRows"
HOT_KEYS = "spark.bandscape.hot.maxKeys"


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def _bytes(df: DataFrame) -> int:
    """Size by the plan's statistics, which start from the bytes of the written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "left", cheap: bool = False,
           bounded: bool = False, reread: bool = False) -> DataFrame:
    """Join ``groups`` (one row per key) to every row of ``df``.

    The group table is computed once, written, and counted from its footers; a
    ``cheap`` one, a projection of a small written table, is not written again.
    Within the limits of rows and bytes it is broadcast, so ``df`` is not shuffled.  A larger
    one is joined by shuffling both sides on the keys plus a salt; one with so
    many groups that copies per slice would be a burden is joined plainly but
    for its hot keys.  Either way no hot group lands in one task.  ``bounded`` says
    that no key has many rows of ``df``; both sides are then shuffled as they are.
    ``reread`` says that ``df`` comes straight from a written table, so its hot keys are
    counted and nothing is copied per slice.

    Joins beyond the limits are merged: the optimiser goes by the bytes of the written
    table, which miss the copies and its compression, and would broadcast it.
    """
    if not cheap and not is_written(groups):
        groups = materialise(groups)
    rows = groups.count()
    if rows <= _setting(df, BROADCAST_ROWS, 100_000) and _bytes(groups) <= _setting(df, BROADCAST_BYTES, 64 << 20):
        return df.join(F.broadcast(groups), keys, how)
    if bounded:
        return df.join(groups.hint("merge"), keys, how)
    if not reread and rows <= _setting(df, SALT_ROWS, 10_000_000):
        return salted_join(df, groups, keys, how)
    return hot_split_join(df, groups, keys, how)


def salted_join(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join to a table that is unique on ``keys`` with hot keys cut into slices."""
    slices = _setting(df, SALT_SLICES, 32)
    spread = [c for c in df.columns if c not in keys] or keys
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(slices)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_split_join(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join to a table that is unique on ``keys``: rows of hot keys meet a
    broadcast, all other rows a plain shuffle.

    A key is hot if it has more than 1/n of all rows, so there are fewer than n
    hot keys at any size of the tables, and few enough to broadcast.
    """
    counts = materialise(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("_n") * _setting(df, HOT_KEYS, 10_000) > total).select(*keys))
    spread = df.join(hot, keys, "left_anti").join(groups.hint("merge"), keys, how)
    dense = df.join(hot, keys, "left_semi").join(F.broadcast(groups.join(hot, keys, "left_semi")), keys, how)
    return spread.unionByName(dense)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, however large a group is.

    Rows are split by ranges of keys and order, so a large group spans many
    parts; a row's number is its place in its part plus the sizes of earlier parts.
    """
    parts = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part")         # one row per part
    starts = sizes.select(*keys, "_part", (F.sum("_n").over(earlier) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (attach(parts, starts, [*keys, "_part"])
            .withColumn(out, (F.col("_start") + F.row_number().over(inside)).cast("int"))
            .drop("_part", "_start"))
