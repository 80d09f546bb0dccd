"""Every query with an SQL counterpart against it, on the smallest tables."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill import catalog


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) if v != int(v) else int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    d = Path("/root/testdata/sf0.001")
    if not d.is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b
    assert b or not name.startswith("lit_")


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) <= set(entry.queries())
