"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillon import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return None if v is None else str(v)


def rows_of(rows, columns, order):
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got, order = df.collect(), sorted(df.columns)
    if name not in SQL:
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == order
    assert rows_of(got, df.columns, order) == rows_of(want.fetchall(), want.columns, order)


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
