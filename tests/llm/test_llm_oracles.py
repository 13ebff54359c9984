"""Each query with SQL against that SQL, on whole tables."""

import os

import duckdb
import pytest
from conftest import DATA
from test_oracles import canonical

from bandscape.llm.workload import QUERIES
from bandscape.llm.workload_sql import ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    assert canonical(got) == canonical(want)
