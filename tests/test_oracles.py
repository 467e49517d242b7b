"""Every query with SQL against DuckDB on the smallest tables; the others run and have a stable schema."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quirespark import catalog


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    theirs = Counter(repr(tuple(map(norm, r))) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLES[name]}) z").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    # the same rows come out of a second plan
    again = catalog.QUERIES[name](spark, sf)
    assert again.schema == df.schema and Counter(map(repr, again.collect())) == Counter(map(repr, rows))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
