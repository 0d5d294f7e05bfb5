"""Sources and sinks, extraction, streams and the engine."""

import json
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine, Request, Unavailable, parse
from tidemark.functions import media
from tidemark.operators import debounce, extract, keyword
from tidemark.operators.extract import Extractor
from tidemark.sources import audit, config, content, walk
from tidemark.sources.warehouse import Warehouse
from tidemark.streaming import breaker, pipeline
from tidemark.streaming import debounce as stream


def test_walk(spark, tmp_path, rows):
    (tmp_path / "d/e").mkdir(parents=True)
    for name in ("a.txt", "d/b.txt", "d/e/c ü.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "a.txt")
    got = walk.guarded(spark, [str(tmp_path)])
    assert rows(got.select(F.regexp_replace("path", str(tmp_path), "").alias("p"), "size")) == [("/a.txt", 5), ("/d/b.txt", 7), ("/d/e/c ü.txt", 12)]
    assert {r.inode for r in got.collect()} == {os.stat(tmp_path / n).st_ino for n in ("a.txt", "d/b.txt", "d/e/c ü.txt")}
    assert walk.walk(spark, [str(tmp_path)], recursive=False).count() == 1
    with pytest.raises(NotADirectoryError):
        walk.guarded(spark, [str(tmp_path / "a.txt")])


def test_content(spark, tmp_path):
    assert content.decode_text(bytes.fromhex("C4E3BAC3")) == "你好" and content.decode_text(bytes.fromhex("9439FC36")) == "😀"
    assert content.decode_text(b"\xef\xbb\xbfa") == "a" and content.decode_text(b"\xff\xff\xff") is None and content.decode_text(None) is None
    assert content.truncate_utf8("ab你好cd", 7) == ("ab你", True) and content.truncate_utf8(None) == (None, False) and content.truncate_utf8("", 1) == ("", False)
    assert content.blob_to_floats(content.floats_to_blob([0.5, -1.0])) == [0.5, -1.0]
    for n in (0, 10, content.WHOLE, content.WHOLE + 1, 300_001):
        data = os.urandom(n)
        p = tmp_path / f"f{n}"
        p.write_bytes(data)
        got = spark.createDataFrame([(bytearray(data),)], "c binary").select(content.sample_hash(F.col("c"))).first()[0]
        assert got == content.sample_hash_of(str(p))


def test_extract(spark, rows):
    def boom(data):
        raise RuntimeError("bad")

    wild = Extractor("wild", "w-1", lambda p, h: p.endswith(".boom"), boom)
    f = spark.createDataFrame([(1, "/a.txt", bytearray(b"hi")), (2, "/b.bin", bytearray(b"\0\1")), (3, "/c.boom", bytearray(b"x")), (4, "/d.txt", None), (5, "/e.txt", bytearray(b"\xff\xff\xff")), (6, "/f.txt", bytearray(b""))], "file_id bigint, path string, content binary")
    got = rows(extract.extract(f, (wild, extract.PLAIN)), "file_id", "kind", "content", "error_class")
    assert got == [(1, "text", "hi", None), (2, "other", "", None), (3, "text", None, "permanent"), (4, "other", None, "permanent"), (5, "text", None, "transient"), (6, "text", "", None)]
    frames = f.coalesce(1).select("file_id", F.lit(0).alias("frame_idx"), "content")
    assert extract.embed(frames, lambda xs: ("m", [[1.0, 0.0]] * len(xs)), 4).where("error IS NULL").count() == 6
    assert extract.embed(frames, lambda xs: ("m", [[1.0]]), 4).where("error IS NULL").count() == 0


def test_media():
    exif = b"Exif\0\0" + b"MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30) + b"\3" + b"\0" * 9
    assert media.header(jpeg) == ("jpeg", 30, 20) and media.orientation(jpeg) == 6 and media.orientation(jpeg[:20]) == 1
    assert media.header(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 6000, 6000)) == ("png", 6000, 6000)
    assert media.acceptable(b"GIF89a" + struct.pack("<HH", 5, 0)) == "empty" and media.acceptable(b"") == "unsupported"
    p = np.arange(24).reshape(4, 6, 1).astype("u1")
    assert media.oriented(p, 6).shape == (6, 4, 1) and media.oriented(p, 6)[0, -1, 0] == p[0, 0, 0]
    clear = np.zeros((4, 6, 4), "u1")
    assert media.square(clear, 8).shape == (8, 8, 3) and (media.square(clear, 8) == 255).all()


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.commit({"t": spark.range(3)}, {"vectors": {"format": 1, "model": "m", "dims": 2, "revision": 5}})
    old = w.manifest()
    w.commit({"t": spark.range(5)})
    assert w.read("t").count() == 5 and w.read("t", old).count() == 3
    assert w.valid_snapshot("m", 2, 5) and not w.valid_snapshot("m", 2, 4) and not w.valid_snapshot("m", 3, 5)
    with w.owner(), pytest.raises(RuntimeError), w.owner():
        pass
    w.commit({"s": spark.range(4).selectExpr("id", "if(id = 1, null, id) AS x")}, sealed=("s",))
    assert w.intact("s") and not w.intact("t") and w.valid_snapshot("m", 2, 5, "s")
    at = w.manifest()
    other = w.commit({"s": spark.range(4).selectExpr("id", "if(id = 2, null, id) AS x")})
    assert not w.intact("s", at | {"tables": other["tables"]}) and w.intact("s", at)
    m = sorted((tmp_path / "manifests").glob("*.json"))[-1]
    m.write_text(m.read_text().replace("v=4", "v=1"))
    with pytest.raises(ValueError):
        w.manifest()


def test_two_commits_of_one_version(spark, tmp_path, monkeypatch):
    w, rival = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    create = w.folder.create
    monkeypatch.setattr(w.folder, "create", lambda *a: (rival.commit({"t": spark.range(2)}), create(*a))[1])
    with pytest.raises(RuntimeError):
        w.commit({"t": spark.range(7)})
    assert rival.read("t").count() == 2


def test_no_machine_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"top_k": 30, "roots": ["/a"]}))
    c = config.load(str(f), {"TIDEMARK_TOP_K": "40", "HOME": "/"})
    assert c.top_k == 40 and c.roots == ("/a",)
    f.write_text(json.dumps({"nonsense": 1, "roots": ["/a", "/a/b"], "retry_ratio": 2}))
    with pytest.raises(ValueError) as e:
        config.load(str(f), {"TIDEMARK_WHAT": "1", "TIDEMARK_TOP_K": "x"})
    assert all(x in str(e.value) for x in ("nonsense", "TIDEMARK_WHAT", "TIDEMARK_TOP_K", "/a/b", "retry_ratio"))


def test_audit(spark, tmp_path):
    out = spark.createDataFrame([(2, "x"), (1, "ü"), (3, None)], "id bigint, action string")
    file = str(tmp_path / "audit.jsonl")
    assert audit.drain(out, file, batch=2) == 3 and audit.drain(out, file) == 0
    assert [json.loads(x)["id"] for x in open(file, encoding="utf-8")] == [1, 2, 3]
    assert audit.acknowledge(out, out.where("id < 3")).count() == 1
    got = audit.redact({"path": "/a/b.txt", "n": 1, "m": ["/x", "ok"], "e": ValueError("/secret")})
    assert got["path"].startswith("sha256:") and got["path"].endswith(".txt") and got["m"][1] == "ok" and got["e"] == "ValueError" and "/" not in json.dumps(got)


def test_breaker(spark, rows):
    b = breaker.Breaker(threshold=3, open_ms=100)
    for ok in (False, True, False, False, False):
        b.done(b.allow(0), ok, 0)
    assert b.state == "open" and b.allow(50) is None
    probe = b.allow(100)
    assert probe is not None and b.allow(100) is None
    b.done(probe - 1, True, 100)
    assert b.state == "half_open"
    b.done(probe, True, 100)
    assert b.state == "closed"
    log = spark.createDataFrame([("d", i, i * 10, ok) for i, ok in enumerate([0, 0, 0, 1, 1])], "dependency string, seq bigint, at_ms bigint, ok int")
    assert rows(breaker.history(log, 3, 20), "seq", "verdict", "state") == [(0, "failed", "closed"), (1, "failed", "closed"), (2, "failed", "open"), (3, "refused", "open"), (4, "ok", "closed")]


def test_stream_is_batch(spark, tmp_path, rows):
    events = [("/r", "created", "/r/a", None, 0, 1), ("/r", "move", "/r/b", "/r/a", 100, 2), ("/r", "modified", "/r/c", None, 200, 3), ("/s", "removed", "/s/x", None, 0, 4), ("/r", "removed", "/r/c", None, 2_000_000, 5)]
    (tmp_path / "in").mkdir()
    for i, e in enumerate([*events, ("/r", "flush", None, None, 9_000_000, 6), ("/s", "flush", None, None, 9_000_000, 7)]):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(dict(zip(("root", "op", "path", "old_path", "at_us", "seq"), e, strict=True))))
    q = stream.debounced(stream.read_changes(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    batch = debounce.debounce(spark.createDataFrame(events, "root string, op string, path_key string, old_key string, at_us bigint, seq bigint"))
    assert stopped(spark, q, "debounced", batch.count()) == rows(batch)


def stopped(spark, q, table, n):
    """Rows of a stream's table once there are ``n``; a stream with alarms never ends by itself."""
    for _ in range(240):
        if spark.table(table).count() >= n:
            break
        time.sleep(0.5)
    q.stop()
    return sorted(map(tuple, spark.table(table).collect()), key=repr)


def test_overflow_makes_the_root_dirty(spark, tmp_path):
    """With room for two paths the third is dropped and said to be; a source's own overflow is passed on."""
    (tmp_path / "in").mkdir()
    events = [("/r", "created", "/r/a", 0), ("/r", "created", "/r/b", 1), ("/r", "created", "/r/c", 2), ("/r", "modified", "/r/a", 3), ("/s", "dirty", None, 5), ("/r", "flush", None, 9)]
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps({"root": r, "op": op, "path": p, "at_us": t, "seq": t}) for r, op, p, t in events))
    q = stream.debounced(stream.read_changes(spark, str(tmp_path / "in")), most=2).writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    got = stopped(spark, q, "bounded", 4)
    assert [(r[0], r[1], r[2]) for r in got] == [("/r", "created", "/r/a"), ("/r", "created", "/r/b"), ("/r", "dirty", "/r"), ("/s", "dirty", "/s")]


def test_commit_stream(spark, tmp_path, rows):
    kind = "seq bigint, kind string, file_id bigint, generation bigint, path string, mtime_ns bigint, status string"
    house = Warehouse(spark, str(tmp_path / "w"))
    docs = spark.createDataFrame([(1, "a.txt", "/a.txt", "hello"), (2, "b.txt", "/b.txt", "bye")], "file_id bigint, filename string, path string, content string")
    first = spark.createDataFrame([(1, "upsert", 1, 1, "/a.txt", 1, "indexed"), (2, "upsert", 2, 1, "/b.txt", 1, "indexed")], kind)
    assert pipeline.commit_batch(house, first, 0, docs) and not pipeline.commit_batch(house, first, 0, docs)
    assert {r[2] for r in rows(house.read("postings"))} == {1, 2}
    pipeline.commit_batch(house, spark.createDataFrame([(3, "delete", 2, 1, None, None, None), (0, "upsert", 1, 0, "/x", 1, "indexed")], kind), 1, docs)
    assert rows(house.read("newest"), "file_id", "kind", "seq") == [(1, "upsert", 1), (2, "delete", 3)]
    assert {r[0] for r in rows(house.read("postings"), "file_id")} == {1}
    stats = house.manifest()["meta"]["keyword"]
    live = docs.where("file_id = 1")
    assert {f: tuple(x) for f, x in stats.items()} == {r["field"]: (r["docs"], r["terms"]) for r in keyword.field_stats(live).collect()}
    words = sorted({r.term for r in keyword.postings(live).collect()})
    got, want = (rows(x.select("file_id", F.round("score", 9))) for x in (keyword.scores(house.read("postings"), stats, words), keyword.bm25(live, words)))
    assert got == want and got


def test_engine(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    f = [(i, f"/r/{n}", f"/r/{n}", 1, 1, 1, None, k, 1, "indexed", "plain-2", "m", 1) for i, n, k in ((1, "red.txt", "text"), (2, "blue.txt", "text"))]
    schema = "file_id bigint, path string, path_key string, size bigint, mtime_ns bigint, inode bigint, sample_hash binary, kind string, generation bigint, status string, extractor_version string, embed_model_version string, indexed_at bigint"
    docs = spark.createDataFrame([(1, "red.txt", "/r/red.txt", " a red thing "), (2, "blue.txt", "/r/blue.txt", "a blue thing")], "file_id bigint, filename string, path string, content string")
    vecs = spark.createDataFrame([(65536, 1, 0, 0, "m", [1.0, 0.0]), (131072, 2, 0, 0, "m", [0.0, 1.0])], "key bigint, file_id bigint, frame_idx int, frame_ts_ms bigint, model_version string, vector array<float>")
    dead = spark.createDataFrame([(1, "/r/red.txt", 1, "extract", "permanent", "plain-2", None, 5)], "file_id bigint, path string, generation bigint, stage string, error_class string, extractor_version string, embed_model_version string, updated_at bigint")
    house.commit({"files": spark.createDataFrame(f, schema), "docs": docs, "vectors": vecs, "dead_letters": dead})
    e = Engine(house, lambda q: ("m", [1.0, 0.0] if "red" in q else [0.0, 1.0]))
    r = e.search(Request("red", top_k=2))
    hits = r.hits.collect()
    assert [h.file_id for h in hits] == [1, 2] and hits[0].sources == "content,semantic" and hits[0].snippet == "a red thing" and not r.degraded_semantic

    def down(q):
        raise Unavailable

    r = Engine(house, down).search(Request("red"))
    assert r.degraded_semantic and [h.file_id for h in r.hits.collect()] == [1]
    with pytest.raises(ValueError):
        e.search(Request(" ", mode="x", top_k=0))
    assert e.adopt_model("m", 2) and not e.adopt_model("m", 2)
    with pytest.raises(ValueError):
        e.adopt_model("m", 3)
    assert e.maintain(10**12)["redrive"].count() == 1
    assert parse(["--kind", "text,image", "--kind", "text", "--limit", "5", "--", "a", "b"]) == Request("a b", "hybrid", 5, None, ("text", "image"), None, None)
