"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, debounce, directory, keyword, metrics, notes, reconcile, reliability, search, tasks, vectors

FILES = "file_id bigint, path string, path_key string, size bigint, mtime_ns bigint, inode bigint, sample_hash binary, kind string, generation bigint, status string, extractor_version string, embed_model_version string, indexed_at bigint"


def files(spark, *rows):
    full = [(i, p, p, s, m, n, None, k, g, st, "plain-3", mv, 1) for i, p, s, m, n, k, g, st, mv in rows]
    return spark.createDataFrame(full, FILES)


@pytest.fixture
def some(spark):
    return files(spark, (1, "/r/a", 1, 10, 7, "text", 1, "indexed", None), (2, "/r/b", 2, 20, None, "image", 2, "failed", "m1"), (3, "/r/d/c", 3, 30, 9, "image", 3, "indexed", "m1"), (4, "/r/d/e/f", 4, 40, 9, "other", 1, "deleted", "m2"), (5, "/rx/a", 3, 30, 11, "text", 1, "pending", None))


def test_catalog(spark, some, rows):
    ids = spark.createDataFrame([(1,), (1,), (99,), (0,), (None,)], "file_id bigint")
    assert rows(catalog.multi_get(some, ids), "file_id") == [(1,)]
    assert [r.path_key for r in catalog.page(some, "/r", "/r/a", 2).collect()] == ["/r/b", "/r/d/c"]
    with pytest.raises(ValueError):
        catalog.select(some, kinds=["music"])
    with pytest.raises(ValueError):
        catalog.select(some, mtime_from=2, mtime_to=1)
    assert rows(catalog.select(some, "/r", ["image"], 20, 30), "file_id") == [(2,), (3,)]
    new = spark.createDataFrame([("/r/a", 0, 5), ("/r/b", 2, 6), ("/r/b", 1, 99), ("/new", 1, 7), ("/newer", 1, None), (None, 1, 1)], "path_key string, generation bigint, size bigint")
    got = {r.path_key: (r.file_id, r.generation, r["size"], r.outcome) for r in catalog.upsert(some, new, ["size"]).collect()}
    assert got["/r/a"] == (1, 1, 1, "stale") and got["/r/b"] == (2, 2, 6, "updated") and got["/new"] == (6, 1, 7, "inserted") and got["/newer"] == (7, 1, None, "inserted") and got["/rx/a"] == (5, 1, 3, "kept")
    moves = spark.createDataFrame([(1, 1, "/r/z"), (1, 2, "/r/z"), (1, 1, "/r/d/e/f"), (1, 1, "/r/a"), (8, 1, "/q")], "file_id bigint, generation bigint, new_path string")
    assert rows(catalog.relocate(some, moves), "new_path", "outcome") == [("/q", "not_found"), ("/r/a", "moved"), ("/r/d/e/f", "path_ownership"), ("/r/z", "moved"), ("/r/z", "stale")]
    gone = catalog.mark_deleted(some, some.where("file_id = 1").unionByName(some.where("file_id = 1")))
    assert rows(gone.where("file_id IN (1, 3)"), "file_id", "status", "indexed_at") == [(1, "deleted", None), (3, "indexed", 1)]
    assert rows(catalog.key_collisions(some, F.regexp_replace("path_key", "^/rx?", ""))) == [("/a", 2)]


TASKS = "task_id bigint, file_id bigint, path string, state string, op string, priority int, attempts bigint, crash_count bigint, claim_attempt_charge int, generation bigint, next_attempt_at bigint, created_at bigint"


def test_queue_walk(spark, rows):
    t = spark.createDataFrame([(1, 1, "/a", "pending", "upsert", 0, 0, 0, 1, 2, 0, 0)], TASKS)
    c = tasks.claim(t, 1, 5)
    assert rows(c, "state", "attempts") == [("in_flight", 1)]
    parked = tasks.transition(c, spark.createDataFrame([(1, "park"), (1, "done"), (1, "release"), (9, "done")], "task_id bigint, event string"))
    assert rows(parked, "task_id", "event", "outcome", "state", "attempts", "claim_attempt_charge") == [(1, "done", "ok", "done", 1, 1), (1, "park", "ok", "waiting_dep", 0, 0), (1, "release", "invalid_transition", "in_flight", 1, 1), (9, "done", "not_found", None, None, None)]


@pytest.mark.parametrize(("fresh", "retry", "want"), [(80, 80, (80, 20)), (0, 10, (0, 10)), (200, 3, (97, 3)), (0, 0, (0, 0))])
def test_fair_share(spark, fresh, retry, want):
    t = spark.createDataFrame([(i, i, f"/p{i}", "pending", "upsert", 1, 0 if i < fresh else 2, 0, 1, 1, 0, 0) for i in range(fresh + retry)], TASKS)
    got = [r.source for r in tasks.interleave(t, 1, 100).orderBy("slot").collect()]
    assert (got.count("fresh"), got.count("retry")) == want
    if min(fresh, retry) >= 20:
        assert all((s == "retry") == (i % 5 == 4) for i, s in enumerate(got))


def test_queue_folds(spark, rows):
    req = spark.createDataFrame([("/a", None, 1, 8, "upsert", None, 50, 1), ("/a", 7, 2, 9, "relocate", "/o", 60, 2), ("/a", None, 2, 3, "remove", None, 70, 3), (None, 1, 1, 1, "upsert", None, 1, 4)], "path string, file_id bigint, generation bigint, priority int, op string, old_path string, next_attempt_at bigint, seq bigint")
    assert rows(tasks.coalesce_requests(req)) == [("/a", 2, 7, "remove", None, 3, 50, 3)]
    t = spark.createDataFrame([(1, 1, "/a", "in_flight", "upsert", 0, 1, 0, 1, 1, 0, 0), (2, 1, "/b", "in_flight", "upsert", 0, 1, 1, 1, 1, 0, 0), (3, 1, "/a", "pending", "upsert", 0, 0, 0, 1, 2, 0, 0), (4, 1, "/b", "waiting_dep", "upsert", 0, 0, 0, 1, 3, 0, 0)], TASKS)
    assert rows(tasks.recover(t), "task_id", "state", "crash_count") == [(1, "pending", 1), (2, "dead", 2), (3, "pending", 0), (4, "waiting_dep", 0)]
    assert tasks.claimable(t, 1).count() == 0  # its path has one in flight
    wanted = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "batch bigint, task_id bigint")
    assert rows(tasks.park(t, wanted), "batch", "parked") == [(1, True), (1, True), (2, False), (2, False)]
    assert rows(tasks.superseded(t, files(spark)), "task_id") == [(1,), (2,)]
    u = [spark.range(1).select(tasks.backoff_ms(F.lit(a), 5000, 1_800_000)).first()[0] for a in (-10, 0, 1, 8, 9, 2**30)]
    assert u == [5000, 5000, 10_000, 1_280_000, 1_800_000, 1_800_000]


def test_reconcile(spark, some, rows):
    snap = spark.createDataFrame([("/r", "/r/a", 1, 10, 7), ("/r", "/r/a", 1, 10, 7), ("/r", "/r/b", 2, 20, None), ("/r", "/r/d/e/f", 4, 40, 9), ("/r", "/r/new", 3, 30, 9), ("/r", None, 1, 1, 1), ("/r", "/r/fresh", 5, 5, None)], "root string, path_key string, size bigint, mtime_ns bigint, inode bigint")
    assert rows(reconcile.classify(snap, some), "path_key", "outcome") == [("/r/a", "unchanged"), ("/r/b", "unchanged"), ("/r/d/e/f", "modified"), ("/r/fresh", "added"), ("/r/new", "added")]
    assert rows(reconcile.removed(snap, some), "file_id") == [(3,), (5,)]
    assert rows(reconcile.relocations(snap, some)) == [("/r/new", "/r/d/c", 3)]
    diffs = spark.createDataFrame([("/r/a", 1, "upsert"), ("/r/a", 5, "upsert"), ("/old", 1, "remove"), ("/old", 1, "upsert")], "path_key string, generation bigint, kind string")
    active = spark.createDataFrame([("/r/a", 2, "retry_wait", "upsert", None), ("/n", 1, "pending", "relocate", "/old"), ("/r/a", 9, "done", "upsert", None)], "path_key string, generation bigint, state string, op string, old_path_key string")
    assert rows(reconcile.covered(diffs, active)) == [("/old", 1, "remove"), ("/r/a", 1, "upsert")]
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/a",)], "root string")
    assert rows(reconcile.overlaps(roots)) == [("/a/b", "/a")] and rows(reconcile.collapse_nested(roots)) == [("/a",), ("/ab",)]


def test_directory(spark, rows):
    f = files(spark, *[(i, p, 1, 1, 1, "text", 1, "indexed", None) for i, p in enumerate(["/foo", "/foo/a.txt", "/foo/nested/b.txt", "/foobar/c.txt"], 1)])
    parents = spark.createDataFrame([("/foo", 3)], "directory string, priority int")
    assert rows(directory.expand_remove(parents, f)) == [("/foo/a.txt", 2, 2, 3, "remove"), ("/foo/nested/b.txt", 3, 2, 3, "remove")]
    moves = spark.createDataFrame([("/foo", "/bar")], "directory string, destination string")
    assert rows(directory.expand_relocate(moves, f), "old_path_key", "path_key") == [("/foo/a.txt", "/bar/a.txt"), ("/foo/nested/b.txt", "/bar/nested/b.txt")]
    t = spark.createDataFrame([(1, "/a", False), (2, "/foobar/a", False), (3, "/foo/a", False), (4, "/x", True)], "task_id bigint, path string, is_dir boolean")
    s = spark.createDataFrame([("/a", False), ("/foo", True), ("/x/y", False), ("/x/z", True)], "scope string, is_dir boolean")
    assert rows(directory.scope_conflicts(t, s)) == [(1, "/a"), (3, "/foo"), (4, "/x/y"), (4, "/x/z")]


S = 1_000_000


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("created", "a", None, 0), ("modified", "a", None, S // 10)], [("created", "a", None)]),
        ([("created", "a", None, 0), ("removed", "a", None, S // 10)], []),
        ([("modified", "a", None, 0), ("removed", "a", None, S // 10)], [("removed", "a", None)]),
        ([("removed", "a", None, 0), ("created", "a", None, S // 10)], [("modified", "a", None)]),
        ([("move", "b", "a", 0), ("removed", "b", None, S // 10)], [("removed", "a", None)]),
        ([("move", "b", "a", 0), ("modified", "b", None, S // 10)], [("move", "b", "a")]),
        ([("created", "a", None, 0), ("move", "b", "a", S // 10)], [("created", "b", None)]),
        ([("move", "a", "x", 0), ("move", "b", "a", S // 10)], [("move", "b", "x")]),
        ([("move", "b", "a", 0), ("created", "a", None, 1), ("removed", "b", None, 2)], [("created", "a", None)]),
        ([("modified", "a", None, 0), ("modified", "a", None, S)], [("modified", "a", None), ("modified", "a", None)]),
    ],
)
def test_merge_table(events, want):
    assert [x[:3] for x in debounce.fold(events)] == want


def test_debounce_is_the_fold(spark, rows):
    rng = random.Random(1)
    events, at = [], 0
    for seq in range(800):
        at += rng.choice([0, 10, 300_000, 900_000, 1_000_000, 700_000_000]) if rng.random() < 0.3 else rng.randrange(200_000)
        op = rng.choice(["created", "modified", "removed", "move"])
        events.append(("/r", op, rng.choice("abcd"), rng.choice("abcd") if op == "move" else None, at, seq))
    want = sorted((op, p, o, t) for op, p, o, t in debounce.fold([(op, p, o, t) for _, op, p, o, t, _ in events]))
    shuffled = events + events[:40] + [("/r", "touch", "a", None, 5, 9999), ("/r", "move", "a", None, 5, 9998), (None, "created", "a", None, 5, 9997)]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "root string, op string, path_key string, old_key string, at_us bigint, seq bigint")
    assert sorted(rows(debounce.debounce(df), "op", "path", "old_path", "at_us"), key=repr) == sorted(want, key=repr)
    assert debounce.debounce(df.limit(0)).count() == 0


def test_vectors(spark, rows):
    c = spark.createDataFrame([("v1", 2)], "model_version string, dims int")
    v = spark.createDataFrame([(1, 0, None, 2, [0.6, 0.8], "v1"), (1, 0, None, 2, [0.6, 0.8], "v1"), (2, 0, 5, 2, [float("nan"), 1.0], "v1"), (3, 0, 5, 2, [0.0, 0.0], "v1"), (4, 0, 5, 2, [1.0], "v1"), (5, 0, 5, 2, None, "v1"), (6, 0, 5, 2, [1.0, 0.0], "v9"), (7, 70000, -1, 3, [2.0, 0.0], " ")], "file_id bigint, frame_idx int, frame_ts_ms bigint, dims int, vector array<float>, model_version string")
    assert rows(vectors.valid_vectors(v, c), "file_id", "frame_idx") == [(1, 0)]
    bad = {r.file_id: r.p for r in v.select("file_id", F.array_join(vectors.problems(), ",").alias("p")).collect()}
    assert bad == {1: "", 2: "finite", 3: "norm", 4: "dims", 5: "empty", 6: "", 7: "frame_idx,frame_ts,model,dims,norm"}
    old = v.where("file_id IN (1, 3)").distinct()
    new = v.where("file_id IN (1, 6)").distinct().withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    log = vectors.changes(old, new)
    assert rows(log) == [(1, 1, 0, "delete"), (2, 1, 0, "upsert"), (3, 3, 0, "delete"), (4, 6, 0, "upsert")]
    assert rows(vectors.replay(log), "file_id", "op") == [(1, "upsert"), (3, "delete"), (6, "upsert")]
    assert vectors.replay_health(log, 0, new).first().gap is False and vectors.replay_health(log.where("revision <> 2"), 0, new).first().gap is True
    assert vectors.changes(old, old).count() == 0


def test_hybrid_exact(spark):
    kw = spark.createDataFrame([(1, 9.0), (1, 8.0), (2, 7.0)], "file_id bigint, score double")
    vec = spark.createDataFrame([(131072, 2, 0, 200, 0.99), (131073, 2, 1, 300, 0.80), (65536, 1, 0, 100, 0.70)], "key bigint, file_id bigint, frame_idx int, frame_ts_ms bigint, score double")
    f = files(spark, (1, "/root/one.txt", 1, 1, 1, "text", 1, "indexed", "m"), (2, "/root/two.png", 1, 1, 1, "image", 1, "indexed", "m"))
    got = search.fuse(search.ranked(kw, f, 8), search.ranked(vec, f, 8), 2).collect()
    assert [(r.file_id, r.sources) for r in got] == [(1, "content,semantic"), (2, "content,semantic")]
    assert got[0].score == got[1].score == round(1 / 61 + 1 / 62, 9)
    assert [(r.file_id, r.frame_ts_ms) for r in search.best_frames(vec).orderBy("file_id").collect()] == [(1, 100), (2, 200)]


@pytest.mark.parametrize(("wanted", "hits", "incomplete"), [("file_id = 81", 1, False), ("file_id = 0", 0, False)])
def test_window(spark, wanted, hits, incomplete):
    kw = spark.range(1, 82).select(F.col("id").alias("file_id"), (100.0 - F.col("id")).alias("score"))
    got, more = search.window_search(kw, F.expr(wanted), 20)
    assert got.count() == hits and more is incomplete
    many = spark.range(1, 1500).select(F.col("id").alias("file_id"), (2000.0 - F.col("id")).alias("score"))
    assert search.window_search(many, F.expr("file_id = 1400"), 20)[1] is True


def test_stored_index(spark, rows, tmp_path):
    """Scores read from a stored index are those of the documents; only the buckets of the terms are read."""
    docs = spark.createDataFrame([(i, f"f{i % 3}.txt", f"/d/{i % 5}/f{i % 3}.txt", " ".join(f"w{(i * j) % 11}" for j in range(i % 9)) if i % 7 else None) for i in range(60)], "file_id bigint, filename string, path string, content string")
    keyword.laid_out(keyword.index_rows(docs), 8).write.partitionBy("bucket").parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    stats = {r["field"]: (r["docs"], r["terms"]) for r in keyword.field_stats(docs).collect()}
    for query in (["w1"], ["w2", "f1", "d", "w2"], ["nowhere"], []):
        got, want = (rows(x.select("file_id", F.round("score", 9))) for x in (keyword.scores(stored, stats, query, buckets=8), keyword.bm25(docs, query)))
        assert got == want
    assert rows(keyword.scores(stored, stats, ["f1"], keep=docs.where("file_id = 4"), buckets=8), "file_id") == [(4,)]
    plan = keyword.lookup(stored, ["w1"], 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan


def test_hybrid_ranks_whole_lists(spark):
    """Against ranks of all: a file far down one list keeps its share of it."""
    import random

    rng = random.Random(4)
    a = [(i, float(rng.randrange(40))) for i in range(1, 600)]
    b = [(i, float(rng.randrange(40))) for i in range(200, 900)]
    schema = "file_id bigint, score double"
    got = [(r.file_id, r.score, r.best_rank, r.sources) for r in search.hybrid(spark.createDataFrame(a + a[:9], schema), spark.createDataFrame(b, schema), 5).collect()]
    ranks = [{i: at + 1 for at, (i, _) in enumerate(sorted(x, key=lambda r: (-r[1], r[0])))} for x in (a, b)]
    want = sorted(((i, round(sum(1 / (60 + r[i]) for r in ranks if i in r), 9), min(r[i] for r in ranks if i in r), ",".join(n for n, r in zip(("content", "semantic"), ranks, strict=True) if i in r)) for i in {*ranks[0], *ranks[1]}), key=lambda x: (-x[1], x[2], x[0]))
    assert got == want[:5]
    assert search.hybrid(spark.createDataFrame([], schema), spark.createDataFrame([], schema), 5).count() == 0


def test_sessions_without_a_fold(spark):
    """Every sequence of up to five ops against the fold, also over the edges of slices."""
    from itertools import product

    events, want = [], []
    for n, ops in enumerate(x for k in range(1, 6) for x in product(("created", "modified", "removed"), repeat=k)):
        at = [1_000_000 + n % 700_000 + 400_000 * i for i in range(len(ops))]
        events += [("/r", op, f"/r/{n}", None, t, i) for i, (op, t) in enumerate(zip(ops, at, strict=True))]
        want += [(p, t, op) for op, p, _, t in debounce.fold([(op, f"/r/{n}", None, t) for op, t in zip(ops, at, strict=True)])]
    df = spark.createDataFrame(events, "root string, op string, path_key string, old_key string, at_us bigint, seq bigint")
    assert sorted(map(tuple, debounce.merge_same_path(df).collect())) == sorted(want)
    short = debounce.bursts(df.select(F.col("path_key").alias("root"), "op", "at_us", "seq"), slice_us=500_000)
    long = debounce.bursts(df.select(F.col("path_key").alias("root"), "op", "at_us", "seq"))
    key = ["root", "at_us", "seq", "op", "burst", "before"]
    assert sorted(map(tuple, short.select(key).collect()), key=repr) == sorted(map(tuple, long.select(key).collect()), key=repr)


def test_same_content_by_the_whole_hash(spark, tmp_path):
    """Files of one hash make a group; a shared start of the hash doesn't."""
    from tidemark.plans import files as plans

    f = [(1, "aa" * 16), (2, "aa" * 16), (3, "aa" * 15 + "ab"), (4, None)]
    df = spark.createDataFrame(f, "file_id bigint, h string").select("file_id", F.unhex("h").alias("sample_hash"), F.lit("indexed").alias("status"), F.lit(1).cast("long").alias("generation"))
    df.write.parquet(f"{tmp_path}/files.parquet")
    assert [(r["hash"], r["n"], r["first_id"]) for r in plans.BOOK.queries["sample_hash_dups"](spark, str(tmp_path)).collect()] == [("aa" * 16, 2, 1)]


def test_roots_that_do_not_go_down(spark, rows):
    df = spark.createDataFrame([("/a", False), ("/a/b", True), ("/a/b/c", True), ("/d", None), ("/d/e", False)], "root string, recursive boolean")
    assert rows(reconcile.collapse_nested(df)) == [("/a",), ("/a/b",), ("/d",)]
    assert rows(reconcile.collapse_nested(df.select("root"))) == [("/a",), ("/d",)]


TASK = "task_id bigint, path string, state string, priority int, attempts int, claim_attempt_charge int, generation bigint, next_attempt_at bigint"


def test_scheduler(spark, rows, tmp_path):
    """Claims are stored before the work; what the work says is stored after it; a task it says nothing of gives its claim back."""
    from tidemark.sources.warehouse import Warehouse
    from tidemark.streaming import scheduler

    t = [(1, "/a", "pending", 2, 0, 1, 1, 0), (2, "/b", "retry_wait", 1, 1, 1, 1, 50), (3, "/b", "pending", 1, 0, 1, 2, 0), (4, "/c", "retry_wait", 1, 1, 1, 1, 500), (5, "/d", "waiting_dep", 3, 1, 0, 1, 0), (6, "/e", "in_flight", 1, 1, 1, 1, 0), (7, "/e", "pending", 1, 0, 1, 1, 0), (8, "/f", "pending", 9, 0, 1, 1, 0)]
    house = Warehouse(spark, str(tmp_path))
    house.commit({"tasks": spark.createDataFrame(t, TASK)})
    seen = []

    def work(claimed):
        seen.append(sorted(r.task_id for r in claimed.collect()))
        assert house.read("tasks").where(F.col("task_id").isin(seen[-1]) & (F.col("state") == "in_flight")).count() == len(seen[-1])
        return claimed.where("task_id <> 1").selectExpr("task_id", "CASE task_id WHEN 3 THEN 'done' ELSE 'retry' END AS event").unionByName(spark.createDataFrame([(6, "done")], "task_id bigint, event string"))

    assert scheduler.run(house, work, lambda: 100, lambda: False, limit=3) == 4
    assert seen == [[1, 3, 5], [8]]  # the newer task of /b took its slot, /e is busy, /c isn't due
    assert rows(house.read("tasks"), "task_id", "state", "attempts") == [(1, "retry_wait", 0), (3, "done", 1), (4, "retry_wait", 1), (5, "retry_wait", 2), (6, "in_flight", 1), (7, "pending", 0), (8, "retry_wait", 1)]


def test_points_notes_and_text(spark, rows):
    n = spark.createDataFrame([(4, 1, "file", None, None, "a", None)], "note_id bigint, file_id bigint, anchor_type string, anchor_line int, anchor_ts_ms bigint, content string, expire_at bigint")
    new = spark.createDataFrame([(2, "line", 3, None, "b", None), (1, "file", None, None, "c", 9), (1, "line", None, None, "no line", 9), (1, "file", None, None, "", 9)], "file_id bigint, anchor_type string, anchor_line int, anchor_ts_ms bigint, content string, expire_at bigint")
    more = notes.create(n, new)
    assert rows(more, "note_id", "content") == [(4, "a"), (5, "c"), (6, "b")] and rows(notes.create(n, new.limit(0)), "note_id") == [(4,)]
    changed = notes.update(more, spark.createDataFrame([(4, "x", 7), (5, "", 8), (99, "y", 1), (None, "z", 1)], "note_id bigint, content string, expire_at bigint"))
    assert rows(changed, "note_id", "content", "expire_at") == [(4, "x", 7), (5, "c", 9), (6, "b", None)]
    assert catalog.point(changed, "note", note_id=5)["content"] == "c"
    with pytest.raises(catalog.NotFound):
        catalog.point(changed, "note", note_id=77)
    with pytest.raises(ValueError):
        catalog.point(changed, "note", content="c")
    from tidemark.functions.text import readable

    data = [b"ok", b"a\xffb", b"\xe4\xbd", None, b""]
    got = [r[0] for r in spark.createDataFrame([(bytearray(d) if d is not None else None,) for d in data], "d binary").select(readable(F.col("d"))).collect()]
    assert got == [d.decode("utf-8", "replace") if d is not None else None for d in data]
    chain = spark.createDataFrame([([("A", "x\"y"), ("B", "z")],), ([],), (None,)], "c array<struct<type:string,message:string>>").select(tasks.error_chain(F.col("c")))
    assert [r[0] for r in chain.collect()] == ['[{"type":"A","message":"x\\"y"},{"type":"B","message":"z"}]', "[]", "[]"]


def test_keyword(spark, rows):
    d = spark.createDataFrame([(1, "a.md", "/docs/a.md", "reliable distributed search engine search"), (2, "b.md", "/docs/中文.md", "这是一个分布式非结构化索引引擎"), (3, "reliable.txt", "/x", None), (4, "", "", "")], "file_id bigint, filename string, path string, content string")
    assert rows(keyword.bm25(d, ["分布", "布式"]), "file_id") == [(2,)]
    top = keyword.top(keyword.bm25(d, ["reliable", "nothing"]), 5).collect()
    assert [r.file_id for r in top] == [3, 1] and top[0].rank == 1
    assert keyword.bm25(d, []).count() == 0
    assert ("search", "content", 1, 2) in rows(keyword.postings(d))
    receipts = keyword.commit(spark.createDataFrame([(1, 1, "delete", 5, 0), (1, 1, "upsert", 4, 0), (2, 9, "upsert", 1, 0), (7, 1, "upsert", 1, 0)], "file_id bigint, generation bigint, op string, seq bigint, copy bigint"), files(spark, (1, "/a", 1, 1, 1, "text", 1, "indexed", None), (2, "/b", 1, 1, 1, "text", 1, "indexed", None)))
    assert rows(receipts, "file_id", "seq", "receipt") == [(1, 4, "coalesced"), (1, 5, "committed"), (2, 1, "stale"), (7, 1, "stale")]
    assert {r[2] for r in rows(keyword.apply_commit(keyword.postings(d), d, receipts))} == {2, 3}


def test_reliability_notes_metrics(spark, some, rows):
    dead = spark.createDataFrame([(2, "/r/b", 2, "extract", "transient", "plain-2", None, 5), (3, "/r/d/c", 1, "embed", "permanent", None, "m1", 10**13), (9, "/gone", 1, "io", "transient", None, None, 5)], "file_id bigint, path string, generation bigint, stage string, error_class string, extractor_version string, embed_model_version string, updated_at bigint")
    assert rows(reliability.redrive(dead, some, error_class="transient"), "file_id", "outcome") == [(2, "enqueued"), (9, "missing")]
    assert rows(reliability.redrive(dead, some, ids=[3]), "file_id", "outcome") == [(3, "superseded")]
    with pytest.raises(ValueError):
        reliability.redrive(dead, some)
    assert rows(reliability.version_mismatch(dead, "plain-3", ""), "file_id") == [(2,)]
    assert rows(reliability.forget(dead, reliability.expired(dead, 10**12)), "file_id") == [(3,)]
    batch = reliability.model_upgrade_batch(some, "m2", 1).collect()
    assert [(r.file_id, r.generation, r.has_more) for r in batch] == [(3, 4, False)]
    n = spark.createDataFrame([(1, 1, "line", 7, None, "x", 5), (2, 1, "timestamp", None, 5000, "x", None), (3, 1, "file", None, None, "x", None), (4, 1, "file", 1, None, "", 99), (5, 1, "line", None, None, "x", 10)], "note_id bigint, file_id bigint, anchor_type string, anchor_line bigint, anchor_ts_ms bigint, content string, expire_at bigint")
    assert rows(notes.live(n, 10), "note_id") == [(2,), (3,), (4,)] and rows(notes.expired(n, 10), "note_id") == [(1,), (5,)]
    assert rows(n.select("note_id", notes.invalid().alias("p")).where("p IS NOT NULL")) == [(4, "content"), (5, "anchor")]
    h = metrics.histogram(spark.createDataFrame([("a", 0.02), ("a", 9.0), ("a", None)], "s string, v double"), "v", ["s"], [0.01, 0.05])
    assert rows(h) == [("a", 0.01, 0), ("a", 0.05, 1), ("a", float("inf"), 2)]
    none = spark.createDataFrame([], "state string, dirty boolean")
    assert metrics.health(none).first().status == "ready"
