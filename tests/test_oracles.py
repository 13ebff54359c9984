"""Every query against its SQL counterpart, on whole tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(frame):
    def value(v):
        if pd.isna(v):
            return (0, "")
        if isinstance(v, (int, float, bool, np.integer, np.floating, np.bool_)):
            return (1, float(v))
        return (2, str(v))

    return sorted(tuple(value(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert canonical(got) == canonical(want)


def test_entry(spark):
    rows = entry.entry(spark).toPandas()
    assert len(rows) > 0 and rows.score.between(0, 1).all() and not math.isnan(rows.score.sum())
