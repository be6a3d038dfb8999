"""Every catalogue query with a SQL counterpart equals DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t[:-8]} as select * from '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    o = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in o.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in o.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
