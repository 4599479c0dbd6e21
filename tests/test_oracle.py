"""Every query against its SQL in DuckDB on the driver's tables."""

import glob
import os

import duckdb
import pytest

from quantloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def table(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, db, name):
    q = QUERIES[name]
    df = q(spark, SF)
    cur = db.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want, got = cur.fetchall(), df.collect()
    assert df.columns == cols
    a, b = table(got), table(want)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b):
        assert x == y, f"{x} != {y}"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
