"""Every registered query of the library with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from terrace.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.8g}")
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=repr)


def test_no_cross_product_in_overlaps(spark):
    plan = QUERIES["column_pair_overlaps"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
