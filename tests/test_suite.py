"""Every query against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from weirflow import suite

QUERIES, SQL = suite.queries(), suite.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in suite.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall())
    assert got == want
