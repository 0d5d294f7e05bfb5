import random

import pytest

from tidemark.llm import subjects

WORDS = {"tea": ["kettle", "leaf", "steep", "cup", "brew", "infuse", "pot", "steam"], "chess": ["rook", "pawn", "gambit", "mate", "queen", "board", "castle", "endgame"], "rail": ["signal", "track", "train", "platform", "sleeper", "points", "depot", "tram"]}
COMMON = ["This page was copied today.", "See the list for the rest.", "The folder was moved again."]


def sentence(rng, s):
    a, b, c = rng.sample(WORDS[s], 3)
    return f"The {a} and the {b} with a {c} were noted{rng.choice(['', ' as before', ' once more'])}."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    docs, truth = [], {}
    names = list(WORDS)
    for i in range(400):
        main, other = rng.sample(names, 2)
        mix = rng.choice([(8, 0), (4, 4), (9, 1)])
        parts = [sentence(rng, main) for _ in range(mix[0])] + [sentence(rng, other) for _ in range(mix[1])] + rng.choices(COMMON, k=3)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x"))
        truth[i] = {main} | ({other} if mix[1] == 4 else set())
    samples = [(s if k else names[0], "en", " ".join([sentence(rng, s) for _ in range(4)] + [rng.choice(COMMON)]), "x") for s in names for k in range(14)]
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, " ".join(COMMON), "x"), (1003, "123 !!", "x")]
    return spark.createDataFrame(docs + odd, "doc_id bigint, text string, subject string"), spark.createDataFrame(samples, "subject string, lang string, text string, doc_id string"), truth


def test_accuracy(spark, tables):
    docs, samples, truth = tables
    got: dict[int, set] = {}
    for r in subjects.assign(docs, samples).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.share >= subjects.SHARE
    assert not got.keys() & {1000, 1001, 1002, 1003}
    assert sum(got.get(i) == t for i, t in truth.items()) / len(truth) > 0.9


def test_nothing(spark, tables):
    docs, samples, _ = tables
    assert subjects.assign(docs.limit(0), samples).count() == 0
    assert subjects.assign(docs, samples.limit(0)).count() == 0


def test_on_the_samples(spark, data):
    """Held-out accuracy: every other sample is a document, the others are seeds."""
    sf = data.replace("0.001", "0.01")
    samples = spark.read.parquet(f"{sf}/subject_samples.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = samples.where("sample_id % 2 = 0")
    got: dict[int, set] = {}
    for r in subjects.assign(docs.unionByName(held.selectExpr("-sample_id AS doc_id", "text")), samples.where("sample_id % 2 = 1")).where("doc_id < 0").collect():
        got.setdefault(-r.doc_id, set()).add(r.subject)
    labels = {r.sample_id: r.subject for r in held.collect()}
    assert sum(s in got.get(i, ()) for i, s in labels.items()) / len(labels) > 0.85
