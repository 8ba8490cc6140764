"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fernwork import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v.is_integer() else v


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_same_rows(spark, duck, name):
    a, b = own.QUERIES[name](spark, SF).toPandas(), duck.sql(own.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    same = [sorted(repr(tuple(map(plain, r))) for r in x[sorted(x.columns)].itertuples(index=False, name=None)) for x in (a, b)]
    assert same[0] == same[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
