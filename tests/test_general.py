"""Ledger, change feed and table diff: transitions, brute force and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changefeed, incremental, tablediff

ON = ["file_id", "generation", "mtime_ns"]
ITEM = "file_id bigint, generation bigint, mtime_ns bigint"


def test_current_rows(spark, rows):
    df = spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 3, 7), (1, 2, 9), (2, 1, None), (None, 1, 1), (3, None, 1)], ITEM)
    assert rows(incremental.current_rows(df)) == [(1, 3, 7), (2, 1, None)]
    assert rows(incremental.current_rows(df.limit(0))) == []


def test_replay(spark, rows):
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, None), (6, 2, 1)], ITEM)
    writes = spark.createDataFrame([(1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 2, 2, 1, 1), (3, 1, 3, 1, 1), (2, 1, 4, 1, 1), (9, 9, 4, 1, 1), (1, 1, 5, 1, None), (1, 1, 6, 1, 1)], "run_id bigint, attempt int, file_id bigint, generation bigint, mtime_ns bigint")
    attempts = spark.createDataFrame([(1, 1, "succeeded", 0), (1, 2, "failed", 0), (2, 1, "running", 100), (3, 1, "running", 0), (None, 1, "succeeded", 0)], "run_id bigint, attempt int, state string, s bigint").select("run_id", "attempt", "state", F.timestamp_seconds("s").alias("started_at"))
    got = incremental.replay(items, writes, attempts, ON, F.timestamp_seconds(F.lit(150)), ttl_us=100_000_000)
    assert rows(got, "file_id", "state") == [(1, "done"), (2, "pending"), (3, "pending"), (4, "leased"), (5, "done"), (6, "pending")]
    assert rows(incremental.replay(items, writes.limit(0), attempts.limit(0), ON, F.timestamp_seconds(F.lit(1))), "state") == [("pending",)] * 6


def test_leases_and_fencing(spark, tmp_path, rows):
    """Leases are seen before work is done; one that ran out is taken over, and its holder can't publish any more."""
    items = spark.createDataFrame([(1, 1, 1), (2, 1, None)], ITEM)
    store = incremental.Store(spark, str(tmp_path))
    first = incremental.begin(items, ON, store, 0, 10, "a")
    assert rows(store.book(items, ON, store.log(), 5), "file_id", "state", "token", "owner", "lease_until") == [(1, "leased", first, "a", 10), (2, "leased", first, "a", 10)]
    beside = incremental.begin(items, ON, store, 5, 10, "b")
    assert incremental.leased(items, ON, store, beside).count() == 0 and beside > first
    assert rows(store.book(items, ON, store.log(), 10), "state") == [("pending",)] * 2
    late = incremental.begin(items, ON, store, 20, 10, "c")
    assert incremental.leased(items, ON, store, late).count() == 2
    with pytest.raises(incremental.Stale):
        incremental.publish(store, first)
    assert rows(store.book(items, ON, store.log(), 21), "file_id", "state", "token") == [(1, "leased", late), (2, "leased", late)]
    incremental.publish(store, late)
    incremental.publish(store, late)  # said twice, done once
    assert rows(store.book(items, ON, store.log(), 99), "file_id", "state") == [(1, "done"), (2, "done")]
    with pytest.raises(incremental.Stale):
        incremental.publish(store, first)
    assert [e.kind for e in store.log()] == ["lease", "lease", "lease", "done"]


def test_two_begin_at_once(spark, tmp_path, rows, monkeypatch):
    """Both read the same log; only one gets the next entry, and the other leases what is left."""
    items = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], ITEM)
    store, other = incremental.Store(spark, str(tmp_path)), incremental.Store(spark, str(tmp_path))
    append, rivals = store.append, []

    def beaten(at, entry):
        if not rivals:
            rivals.append(incremental.begin(items.where("file_id = 1"), ON, other, 0, 10, "rival"))
        return append(at, entry)

    monkeypatch.setattr(store, "append", beaten)
    mine = incremental.begin(items, ON, store, 0, 10, "me")
    assert rows(incremental.leased(items, ON, store, mine)) == [(2, 1, 1)] and rows(incremental.leased(items, ON, store, rivals[0])) == [(1, 1, 1)]


def test_runs_skip_and_repeat_nothing(spark, tmp_path, rows):
    store = str(tmp_path)
    first = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 1, 1), (4, 1, None), (5, None, None)], ITEM)
    with pytest.raises(ZeroDivisionError):
        incremental.run_once(first, ON, lambda df: df.where(F.lit(1 / 0)), store, 0)
    assert incremental.finished(spark, store) is None
    incremental.run_once(first, ON, lambda df: df.distinct(), store, 0)
    more = first.union(spark.createDataFrame([(2, 2, 5), (3, 1, 1)], ITEM))
    incremental.run_once(more, ON, lambda df: df, store, 1)
    incremental.run_once(more, ON, lambda df: df, store, 2)
    assert rows(incremental.finished(spark, store)) == sorted([(1, 1, 1), (2, 1, 1), (2, 2, 5), (3, 1, 1), (4, 1, None), (5, None, None)], key=repr)


def test_killed_between_lease_and_publish(spark, tmp_path, rows):
    store = str(tmp_path)
    items = spark.createDataFrame([(1, 1, 1), (2, 1, None)], ITEM)

    class Killed(BaseException):
        pass

    def die(df):
        raise Killed

    with pytest.raises(Killed):
        incremental.run_once(items, ON, die, store, 0, 10)
    incremental.run_once(items, ON, lambda df: df, store, 5, 10)
    assert incremental.finished(spark, store).count() == 0  # the dead run's lease still stands
    incremental.run_once(items, ON, lambda df: df, store, 10, 10)
    incremental.run_once(items, ON, lambda df: df, store, 50, 10)
    assert rows(incremental.finished(spark, store)) == [(1, 1, 1), (2, 1, None)]


FEED = "seq bigint, kind string, file_id bigint, generation bigint, path string, mtime_ns bigint, status string"


def fold(feed):
    """One mutation after the other, in order of (file, generation, seq)."""
    state = {}
    for seq, kind, f, g, *fields in sorted({r for r in feed if r[2] and r[2] > 0 and r[3] and r[3] > 0 and ((r[1] == "upsert" and r[4]) or (r[1] == "delete" and r[4] is None))}, key=lambda r: (r[2], r[3], r[0])):
        if kind == "delete":
            state.pop(f, None)
        else:
            old = state.get(f)
            state[f] = (g, seq, *[b if b is not None or not old or old[0] != g else a for a, b in zip(old[2:] if old else [None] * 3, fields, strict=True)])
    return sorted((f, *v) for f, v in state.items())


def test_feed_any_order(spark, rows):
    rng = random.Random(3)
    feed = []
    for seq in range(1, 600):
        kind = rng.choice(["upsert"] * 5 + ["delete", "touch", None])
        feed.append((seq, kind, rng.choice([1, 1, 1, 2, 3, 4, 5, 0, None]), rng.choice([1, 2, 3, 9, 0, None]), rng.choice([None, "", "/a", "/b"]) if kind == "upsert" else rng.choice([None, None, "/x"]), rng.choice([None, 1, 2]), rng.choice([None, "indexed"])))
    for k in range(3):
        shuffled = feed + rng.sample(feed, 50)
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, FEED).withColumn("top", F.lit("clash"))
        assert rows(changefeed.apply_feed(df)) == sorted(fold(feed), key=repr)
    assert changefeed.apply_feed(spark.createDataFrame([], FEED)).count() == 0


def test_hash_is_spark_s(spark):
    a, b = [1, -5, 2**62, 0, -(2**63)], [7, 7, -1, 0, 3]
    got = [r[0] for r in spark.createDataFrame(list(zip(a, b, strict=True)), "a bigint, b bigint").select(F.xxhash64("a", "b")).collect()]
    assert got == tablediff.hash_longs(np.array(a), np.array(b)).tolist()


SIDE = "k string, x bigint, y string, extra int"


def diff(left, right):
    one = lambda side: {k: max((r[1:3] for r in side if r[0] == k), key=lambda v: tuple((x is not None, x) for x in v)) for k in {r[0] for r in side} - {None}}
    l, r = one(left), one(right)
    out = [(k, "only_in_left") for k in l.keys() - r.keys()] + [(k, "only_in_right") for k in r.keys() - l.keys()]
    return sorted(out + [(k, f) for k in l.keys() & r.keys() for i, f in enumerate(("x", "y")) if l[k][i] != r[k][i]], key=repr)


@pytest.mark.parametrize("share", [0.2, 0.0001])
def test_diff(spark, rows, share):
    rng = random.Random(5)
    left = [(f"/p{i}", rng.choice([None, 1, i]), rng.choice([None, "a", ""]), i) for i in range(400)] + [(None, 1, "a", 1)]
    right = [r if rng.random() < 0.9 else (r[0], rng.choice([None, 1, 2]), rng.choice([None, "a"]), 0) for r in left if rng.random() < 0.95] + [(f"/new{i}", 1, "", 1) for i in range(9)]
    left += left[:30]
    got = tablediff.diff_tables(spark.createDataFrame(left, SIDE), spark.createDataFrame(right + right[:9], SIDE), "k", ["x", "y"], bucket_rows=64, diff_share=share)
    assert rows(got, "k", "field") == diff(left, right)


def test_diff_of_nothing(spark, rows):
    none, one = spark.createDataFrame([], SIDE), spark.createDataFrame([("/a", 1, None, 1)], SIDE)
    assert rows(tablediff.diff_tables(none, none, "k", ["x", "y"])) == []
    assert rows(tablediff.diff_tables(one, none, "k", ["x", "y"]), "k", "field") == [("/a", "only_in_left")]
    assert rows(tablediff.diff_tables(one, one, "k", ["x", "y"])) == []


def test_null_and_shifted_values_differ(spark, rows):
    a = spark.createDataFrame([("/a", None, "1")], "k string, x string, y string")
    b = spark.createDataFrame([("/a", "1", None)], "k string, x string, y string")
    assert rows(tablediff.diff_tables(a, b, "k", ["x", "y"])) == [("/a", "x", None, "1"), ("/a", "y", "1", None)]
