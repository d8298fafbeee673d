import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridstone.plans import fixture_queries as own

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) if isinstance(x, float) else int(x) if isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    want = duck.sql(own.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    rows = lambda got: sorted((tuple(map(plain, r)) for r in got), key=repr)
    assert rows(df.collect()) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_registry(spark):
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
