"""Every query with SQL gives the SQL's rows, over the whole smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    even = lambda v: "~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(even(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, DIR)
    cur = db.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cur.fetchall())
