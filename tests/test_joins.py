"""The path beyond the broadcast limit gives the same rows without a broadcast."""

import os

import pytest
from pyspark.sql import functions as F

from bandscape.functions import joins as J


@pytest.fixture
def tight(spark):
    spark.conf.set(J.BROADCAST_ROWS, "0")
    spark.conf.set(J.SALT_SLICES, "4")
    yield spark
    spark.conf.unset(J.BROADCAST_ROWS)
    spark.conf.unset(J.SALT_SLICES)


def hot(spark):
    # Two thirds of all rows have one key.
    return spark.range(3000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), "id")


@pytest.mark.parametrize("salted", [True, False])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_large_group_tables_equal_broadcast(spark, how, salted):
    df = hot(spark)
    groups = df.filter("k < 1500").groupBy("k").agg(F.sum("id").alias("s"))
    want = sorted(map(tuple, J.attach(df, groups, ["k"], how).collect()), key=str)
    spark.conf.set(J.BROADCAST_ROWS, "0")
    spark.conf.set(J.SALT_ROWS, "1000000" if salted else "0")
    spark.conf.set(J.HOT_KEYS, "20")
    try:
        got = sorted(map(tuple, J.attach(df, groups, ["k"], how).collect()), key=str)
    finally:
        for name in (J.BROADCAST_ROWS, J.SALT_ROWS, J.HOT_KEYS):
            spark.conf.unset(name)
    assert got == want


def test_hot_key_is_cut_into_slices(tight):
    df = hot(tight)
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = J.attach(df, groups, ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    salts = df.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(4))).filter("k = 0").groupBy("s").count().collect()
    assert len(salts) == 4 and max(r["count"] for r in salts) < 700


@pytest.mark.parametrize("kind", ["salted", "bounded", "split"])
def test_small_looking_tables_are_not_broadcast(tight, kind):
    # The optimiser sees the bytes of the written table only, which are few.
    df = hot(tight)
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    if kind == "split":
        tight.conf.set(J.SALT_ROWS, "0")
    try:
        joined = J.attach(df, groups, ["k"], bounded=kind == "bounded")
    finally:
        tight.conf.unset(J.SALT_ROWS)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and ("BroadcastHashJoin" in plan) == (kind == "split")
    assert joined.filter("n IS NULL").isEmpty() and joined.count() == 3000


def test_ranks_of_a_hot_group(spark):
    got = J.ranked(hot(spark), ["k"], ["id"], "pos").filter("k = 0").orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1, 2001))


def test_discarded_table_is_gone_and_others_stay(spark):
    from bandscape.functions import runtime
    first, second = (runtime.materialise(spark.range(n)) for n in (3, 4))
    paths = [runtime._tables[t] for t in (first, second)]
    runtime.discard(first)
    assert not runtime.is_written(first) and runtime.is_written(second) and second.count() == 4
    assert paths[0] not in runtime._written and paths[1] in runtime._written
    assert [os.path.exists(p) for p in paths] == [False, True]
