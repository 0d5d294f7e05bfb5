import random

import duckdb
import glob
import os

import pytest

from tidemark.llm import queries, runs

SCHEMA = "path_key string, op string, old_key string, at_us bigint, seq bigint, min_seq int"


def brute(events, gap=2_000_000):
    out = []
    for path in {e[0] for e in events}:
        last = None
        for _, op, old, at, seq in sorted({e[:5] for e in events if e[0] == path}, key=lambda e: (e[3], e[4])):
            if last and last[1:3] == [op, old] and at - last[6] <= gap:
                last[3], last[4], last[5], last[6] = min(last[3], seq), max(last[4], seq), last[5] + 1, at
            else:
                last = [path, op, old, seq, seq, 1, at, at]
                out.append(last)
    return sorted(((p, op, old, lo, hi, n, to - start) for p, op, old, lo, hi, n, to, start in out), key=repr)


def test_any_slices(spark, rows):
    rng = random.Random(2)
    events, at = [], 0
    for seq in range(1500):
        at += rng.choice([0, 0, 1000, 1_000_000, 2_000_000, 2_000_001, 9_000_000])
        events.append((rng.choice(["/hot"] * 6 + ["/a", "/b"]), rng.choice("xy"), rng.choice([None, None, "/o"]), at, seq if rng.random() < 0.7 else 5000 - seq, 1))
    shuffled = events + events[:200]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA)
    for size in (2_000_000, 5_000_000, 10**12):
        assert rows(runs.collapse_runs(df, slice_us=size), "path_key", "op", "old_key", "min_seq", "max_seq", "n", "duration_us") == brute(events)


def test_odd_rows(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert runs.collapse_runs(none).count() == 0
    df = spark.createDataFrame([(None, "x", None, 1, 1, 0), ("/a", None, None, 1, 1, 0), ("/a", None, None, 2, 2, 0), ("/a", "x", None, None, 3, 0), ("/a", "x", None, 3, None, 0)], SCHEMA)
    assert rows(runs.collapse_runs(df), "path_key", "op", "n") == [("/a", None, 2)]
    with pytest.raises(ValueError):
        runs.collapse_runs(df, gap_us=10, slice_us=5)


def test_long_run_over_many_slices(spark, rows):
    df = spark.createDataFrame([("/a", "x", None, i * 1_000_000, i, 0) for i in range(400)], SCHEMA)
    assert rows(runs.collapse_runs(df, slice_us=3_000_000), "min_seq", "max_seq", "n") == [(0, 399, 400)]


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_canonical(spark, rows):
    raw = spark.createDataFrame([(" Modified\t", "/a//b/", None, "2020-01-01 00:00:00", 1), ("modified", "/a/./b", "", None, 2), ("x", None, None, "2020-01-01 00:00:00", 3)], "op string, path string, old_path string, t string, seq bigint").selectExpr("op", "path", "old_path", "CAST(t AS TIMESTAMP_NTZ) AS at_ts", "seq")
    assert rows(runs.canonical_changes(raw), "path_key", "op", "seq") == [("/a/b", "modified", 1)]
