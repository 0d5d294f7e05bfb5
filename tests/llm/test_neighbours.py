import numpy as np
import pytest

from tidemark.llm import neighbours

V = "file_id bigint, frame_idx int, frame_ts_ms bigint, dims int, vector array<float>, model_version string, key int"


def table(spark, rows):
    return spark.createDataFrame([(f, i, None, len(v) if v is not None else 0, v, m, 0) for f, i, v, m in rows], V)


@pytest.fixture
def contracts(spark):
    return spark.createDataFrame([("a", 8), ("b", 4)], "model_version string, dims int")


def brute(rows, k=10, least=0.9):
    """Pairs by comparing everything with everything; (must, may): ties at the k-th place may go either way."""
    must, may = set(), set()
    for m, d in (("a", 8), ("b", 4)):
        own = {(f << 16) | i: np.array(v, float) for f, i, v, mm in rows if mm == m and v is not None and len(v) == d and np.isfinite(v).all() and np.any(v)}
        keys = sorted(own)
        if not keys:
            continue
        x = np.stack([own[q] / np.linalg.norm(own[q]) for q in keys])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for r, q in enumerate(keys):
            order = np.argsort(-s[r], kind="stable")
            cut = s[r][order[k - 1]] if len(keys) > k else -3
            for c in range(len(keys)):
                pair = (min(q, keys[c]), max(q, keys[c]))
                if c != r and s[r][c] >= least and s[r][c] >= cut - 1e-6:
                    may.add(pair)
                    if s[r][c] > cut + 1e-6 or len(keys) <= k + 1:
                        must.add(pair)
    return must, may


@pytest.mark.parametrize("pivots, crowd", [(8192, 16_000), (4, 16_000), (4, 25)])
def test_pairs(spark, contracts, rows, monkeypatch, pivots, crowd):
    if pivots < 100:  # cells are halved by planes, crowded ones dealt out by a hash, and all is cut into small blocks
        monkeypatch.setattr(neighbours, "PIVOTS", pivots)
        monkeypatch.setattr(neighbours, "CELL", 20)
        monkeypatch.setattr(neighbours, "BLOCK", 24)
        monkeypatch.setattr(neighbours, "CROWD", crowd)
    rng = np.random.default_rng(1)
    data = []
    for c in range(30):
        centre = rng.standard_normal(8)
        data += [(100 * c + i + 1, i % 3, (centre + 0.15 * rng.standard_normal(8)).astype("f4").tolist(), "a") for i in range(12)]
    data += [(9000 + i, 0, rng.standard_normal(4).astype("f4").tolist(), "b") for i in range(60)]
    data += [(7000, 0, None, "a"), (7001, 0, [1.0] * 4, "a"), (7002, 0, [float("nan")] * 8, "a"), (7003, 0, [0.0] * 8, "a"), (7004, 0, [float("inf")] + [0.0] * 7, "a"), (7005, 0, [1.0] * 8, "zzz"), (7006, 0, [], "a"), (7007, 0, [1e-30] * 8, "a"), (7008, 0, [1e30] * 8, "a")]
    df = table(spark, data + data[:50])
    got = set(map(tuple, neighbours.similar_pairs(df, contracts).select("key_a", "key_b").collect()))
    must, may = brute(data)
    assert len(must & got) / len(must) > 0.99 and len(got - may) <= 0.01 * len(may)
    assert all(a < b for a, b in got)


def test_copies(spark, contracts):
    """A class that holds most of the rows: every member is linked to its ten smallest others, and no more."""
    same = [(i + 1, 0, [1.0, 2.0, 3.0, 4.0], "b") for i in range(300)] + [(900, 0, [-1.0, 0.0, 0.0, 0.0], "b")]
    got = neighbours.nearest(table(spark, same + same[:20]), contracts).collect()
    by = {r.key: r.nbrs for r in got}
    assert len(by) == 301 and all(len(v) == 10 for v in by.values())
    keys = sorted(k for k in by if k != 900 << 16)
    assert by[keys[50]] == keys[:10] and by[keys[3]] == [*keys[:3], *keys[4:11]]
    pairs = set(map(tuple, neighbours.similar_pairs(table(spark, same), contracts).select("key_a", "key_b").collect()))
    assert len(pairs) == 55 + 289 * 10  # the eleven smallest among themselves, every other with the ten smallest
    assert all(900 << 16 not in p for p in pairs)


def test_nothing(spark, contracts):
    df = table(spark, [(1, 0, [1.0] * 8, "a")])
    assert neighbours.similar_pairs(df, contracts).count() == 0
    assert neighbours.similar_pairs(df.limit(0), contracts).count() == 0
    assert neighbours.similar_pairs(df, contracts.limit(0)).count() == 0


def test_search_of_copies(spark, contracts, tmp_path):
    """A row that isn't its class's smallest key has an answer too, and answers name the members of classes."""
    from tidemark.llm import queries

    rng = np.random.default_rng(3)
    data = [(i + 1, 0, rng.standard_normal(4).astype("f4").tolist(), "b") for i in range(30)]
    data += [(100, 0, data[4][2], "b"), (300, 0, data[4][2], "b"), (200, 0, data[7][2], "b"), (400, 0, rng.standard_normal(4).astype("f4").tolist(), "b")]
    table(spark, data + data[:3]).write.parquet(f"{tmp_path}/vectors.parquet")
    contracts.write.parquet(f"{tmp_path}/embed_model_contracts.parquet")
    got: dict[int, list] = {}
    for r in sorted(queries.p1_search(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["nbr"] >> 16)
    assert sorted(got) == [i << 16 for i in (100, 200, 300, 400)]
    ids = np.array([f for f, _, _, _ in data])
    x = np.array([v for _, _, v, _ in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q, nbrs in got.items():
        s = x @ x[list(ids).index(q >> 16)]
        s[ids == q >> 16] = -2
        assert len(nbrs) == 10 and len(set(nbrs) & set(ids[np.argsort(-s, kind="stable")[:10]].tolist())) >= 9
    assert got[100 << 16][:2] == [5, 300] and got[300 << 16][:2] == [5, 100] and got[200 << 16][0] == 8


def recall(reps, got):
    """Share of the ten nearest that ``got`` names, for the keys whose file_id is divisible by 100, against all rows."""
    found = []
    for m in reps.select("m").distinct().collect():
        own = reps.where(f"m = {m[0]}").collect()
        x = np.stack([np.frombuffer(r.vec, "f2").astype("f4") for r in own])
        keys = np.array([r.key for r in own])
        for i, k in enumerate(keys):
            if (k >> 16) % 100 == 0:
                s = x @ x[i]
                s[i] = -2
                found.append(len(set(keys[np.argsort(-s)[:10]].tolist()) & set(got.get(int(k), ()))) / 10)
    return np.mean(found), len(found)


@pytest.mark.parametrize("rounds, least, most", [(0, 0, 0.5), (neighbours.ROUNDS, 0.9, 1)])
def test_descent(spark, data, rounds, least, most):
    """The descent makes the lists what they are: without its rounds most neighbours are missing."""
    sf = data.replace("0.001", "0.1")
    graph, reps, _ = neighbours.build_graph(spark.read.parquet(f"{sf}/vectors.parquet"), spark.read.parquet(f"{sf}/embed_model_contracts.parquet"), rounds=rounds)
    share, asked = recall(reps, {r.key: r.nbrs[:10] for r in graph.where("shiftright(key, 16) % 100 = 0").collect()})
    assert asked > 300 and least <= share <= most


def test_first_round(spark, data):
    """A round brings much: blocks are wide enough that the first one already finds most neighbours."""
    sf = data.replace("0.001", "0.1")
    graph, reps, _ = neighbours.build_graph(spark.read.parquet(f"{sf}/vectors.parquet"), spark.read.parquet(f"{sf}/embed_model_contracts.parquet"), rounds=1)
    share, asked = recall(reps, {r.key: r.nbrs[:10] for r in graph.where("shiftright(key, 16) % 100 = 0").collect()})
    assert asked > 300 and share >= 0.83


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 300])
def test_true(n):
    """The places of true values, also in a last row that isn't eight long."""
    rng = np.random.default_rng(n)
    for share in (0, 0.02, 0.5, 1):
        ok = rng.random((3, n)) < share
        assert (neighbours._true(ok) == np.flatnonzero(ok)).all()


def test_better(monkeypatch):
    """The nearest others of each vector against all cosines, with lists of any length and what is known left out."""
    monkeypatch.setattr(neighbours, "STEP", 64)
    rng = np.random.default_rng(2)
    for n, worst in ((1, -2), (90, -2), (700, -2), (700, 0.3), (700, 0.6)):
        x = neighbours._directions(rng.integers(-127, 128, (n, 16)).astype("i1"))
        s = x.astype("f8") @ x.T.astype("f8")
        np.fill_diagonal(s, -2)
        known = np.argsort(-s, axis=1)[:, :16:2]  # every other one of the nearest
        lens, cols, sims = neighbours._better(x, np.full(n, worst, "f4"), 8, np.arange(n).astype("u2"), known.astype("u2"))
        np.put_along_axis(s, known, -2, axis=1)
        for own, found, row in zip(np.split(cols, np.cumsum(lens)[:-1]), np.split(sims, np.cumsum(lens)[:-1]), s, strict=True):
            want = np.sort(row[row > worst])[::-1][:8]
            assert len(own) == len(want) == len(set(own.tolist())) and np.allclose(row[own], found, atol=1e-5) and np.allclose(np.sort(found)[::-1], want, atol=1e-5)


def test_near_copies(spark, contracts):
    """A third of the rows differ in a bit only; no block or task gets them all, and their pairs come out."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    data = [(i + 1, 0, (centre + 1e-3 * rng.standard_normal(8)).astype("f4").tolist(), "a") for i in range(700)]
    data += [(i + 5000, 0, rng.standard_normal(8).astype("f4").tolist(), "a") for i in range(1400)]
    got = neighbours.similar_pairs(table(spark, data), contracts).where("key_b < 701 << 16").select("key_a", "key_b").collect()
    named = {r.key_a for r in got} | {r.key_b for r in got}
    assert len(named) == 700 and len(got) >= 700 * 5


def test_search_recall(spark, data):
    """The queries of the search on the test table against brute force."""
    sf = data.replace("0.001", "0.01")
    vectors, contracts = spark.read.parquet(f"{sf}/vectors.parquet"), spark.read.parquet(f"{sf}/embed_model_contracts.parquet")
    graph, reps, _ = neighbours.build_graph(vectors, contracts)
    got: dict[int, set] = {}
    for r in neighbours.search(graph, reps, reps.where("shiftright(key, 16) % 100 = 0").selectExpr("m", "key AS query", "vec")).collect():
        got.setdefault(r.query, set()).add(r.nbr)
    share, asked = recall(reps, got)
    assert asked >= 5 and share >= 0.9


def test_nothing_known_is_sent(spark, data, monkeypatch):
    """A round sends what its receivers don't know yet, each entry once a group: little is left of it when the lists settle."""
    from pyspark.sql import functions as F

    sf, sent = data.replace("0.001", "0.01"), []
    stage = neighbours.staged

    def counted(df, name="stage"):
        out = stage(df, name)
        if name == "fresh":
            sent.append(out.select(F.sum(F.length("sims"))).first()[0] / 4)
        return out

    monkeypatch.setattr(neighbours, "staged", counted)
    graph, _, _ = neighbours.build_graph(spark.read.parquet(f"{sf}/vectors.parquet"), spark.read.parquet(f"{sf}/embed_model_contracts.parquet"))
    entries = graph.select(F.sum(F.size("nbrs"))).first()[0]
    assert len(sent) > 1 and 0 < sent[-1] < 0.25 * entries and sent[-1] < 0.25 * sent[0]


def test_packets(spark, data, monkeypatch):
    """What a round sends is packed by the size of the table, not by the partitions that Spark shuffles into."""
    from tidemark.session import set_for

    sent, stage = [], neighbours.staged

    def counted(df, name="stage"):
        out = stage(df, name)
        if name == "fresh":
            sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "staged", counted)
    with set_for(spark, "spark.sql.shuffle.partitions", "60"):
        neighbours.build_graph(spark.read.parquet(f"{data}/vectors.parquet"), spark.read.parquet(f"{data}/embed_model_contracts.parquet"), rounds=1)
    assert 0 < sent[0] <= 2 * spark.sparkContext.defaultParallelism * 3  # a group a model
