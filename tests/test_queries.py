"""Every query with SQL against DuckDB, at the smallest scale."""

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import tabulens.fixture_queries  # noqa: F401
from tabulens.queries import ORACLE, QUERIES, flagship_query

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    found = duck.sql(ORACLE[name])
    theirs = [x[0] for x in found.description]
    assert sorted(theirs) == names
    a = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(dict(zip(theirs, r, strict=True))[n]) for n in names) for r in found.fetchall()), key=repr)
    assert a == b


def test_flagship(spark):
    assert flagship_query(spark, str(DATA)).count() == 3
