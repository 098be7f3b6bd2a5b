"""Every query with SQL against DuckDB; every other one runs and gives rows."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from quern import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    rows = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert 0 < len(got) == len(rows)
    for a, b in zip(got, rows):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * max(1, abs(x)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ("hvg_chen2016", "hvg_brennecke"):  # these may find nothing in noise
        assert df.count() > 0
    else:
        df.collect()
