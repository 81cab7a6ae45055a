"""Every registered query of the engine's own operators against its SQL."""

import math
from decimal import Decimal

import duckdb
import pytest

from tidemark import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v + 0.0 if isinstance(v, float) else v


def rows(columns, order, data):
    at = [columns.index(c) for c in order]
    return sorted((tuple(repr(plain(r[i])) for i in at) for r in data))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.columns, got) == rows(rel.columns, df.columns, rel.fetchall())
