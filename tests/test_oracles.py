"""Every query with SQL gives what the SQL gives on the smallest tables; every other one runs."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as e

SQL, QUERIES = e.oracle_sql(), e.queries()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def table(rows, cols):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, con, name):
    assert name in QUERIES
    got = QUERIES[name](spark, tiny)
    want = con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("p")))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert e.entry(spark).count() > 0
