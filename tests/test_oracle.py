"""Every query against its SQL on the small tables; queries without SQL must run and give their columns."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("p") or n.split("_")[0][1:] in ("2", "5", "6") or not n[1].isdigit()])
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    got = [tuple(map(_norm, r)) for r in df.collect()]
    assert df.columns
    if name not in SQL:
        return
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == sorted((tuple(map(_norm, r)) for r in want.fetchall()), key=repr)


def test_sql_only_of_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
