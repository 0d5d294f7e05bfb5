import random

import pytest

from tidemark.llm import garbled

CHAINS = [c for c in garbled.CHAINS if c in {("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 1), ("utf-8", "cp437", 1), ("utf-8", "mac-roman", 1), ("utf-8", "gb18030", 1), ("cp1251", "cp1252", 1), ("koi8-r", "cp1251", 1), ("gb18030", "cp1252", 1)}]


@pytest.fixture(scope="module")
def texts(spark, data):
    rows = spark.read.parquet(data.replace("0.001", "0.01") + "/text_docs.parquet").where("content IS NOT NULL").select("content").distinct().collect()
    return sorted(r[0] for r in rows)


@pytest.fixture(scope="module")
def model(texts):
    return garbled.train(texts)


def test_held_out(model, texts):
    """Garbled copies of sound rows are found, sound ones are not, and chains that keep everything come back."""
    rng = random.Random(6)
    sound = [t for t in texts if t and not t.isascii() and not garbled.judge(model, t)]
    assert len(sound) > 0.85 * sum(1 for t in texts if t and not t.isascii())
    found = total = back = keeps = 0
    for _ in range(300):
        t, chain = rng.choice(sound), rng.choice(CHAINS)
        if garbled.to_bytes(t, chain[0]) is None:
            continue
        g = garbled.garble(t, chain)
        if g == t:
            continue
        total += 1
        found += garbled.judge(model, g) is not None
        if garbled.invert(g, chain) == t:
            keeps += 1
            back += garbled.restore(model, g)[0] == t
    assert total > 100 and found / total > 0.97 and back / keeps > 0.9


def test_parts_are_found(model):
    t = "La reunión será mañana en el salón pequeño. El niño perdió el paraguas en la estación."
    for a, b in ((0, 30), (20, 60), (40, 52)):
        g = t[:a] + garbled.garble(t[a:b], ("utf-8", "cp1252", 1)) + t[b:]
        assert garbled.judge(model, g) and garbled.restore(model, g)[0] == t


def test_every_stretch_comes_back(model):
    """Any number of stretches, and those beside one that is lost."""
    chain = ("cp1251", "cp1252", 1)
    t, between = "Съешь же ещё этих мягких французских булок, да выпей чаю.", "\n" + "plain words of no account " * 200 + "\n"
    assert garbled.restore(model, between.join([garbled.garble(t, chain)] * 20)) == (between.join([t] * 20), ["cp1251 as cp1252"] * 20, True)
    lost = "El ni?o perdi? el paraguas en la estaci?n. El se?or volver? ma?ana. " * 12
    whole = "El niño perdió el paraguas en la estación."
    text = lost + between + garbled.garble(whole, ("utf-8", "cp1252", 1))
    assert garbled.judge(model, text).fixed is None
    fixed, names, lossless = garbled.restore(model, text)
    assert fixed == lost + between + whole and "utf-8 as cp1252" in names and not lossless


def test_any_place_of_a_long_text(spark, rows, model):
    """Lost characters before capitals, thirty stretches in one text, and Han text without a blank, garbled where a fixed cut would lie."""
    one, many = ("utf-8", "cp1252", 1), "El niño perdió el paraguas en la estación."
    han = "清晨的河面浮着一层薄雾，老人把小船推离岸边，慢慢划向对岸的村庄。" * 1600
    assert len(han) > 50_000 and not garbled.judge(model, han[:3000])
    broken = han[:19_990] + garbled.garble(han[19_990:20_020], one) + han[20_020:]
    texts = [
        "M?NCHEN UND K?LN: DIE S?DDEUTSCHE GR??E DER M?HLE IN T?BINGEN, F?NF ?BER ALLE ST?DTE. " * 3,
        ("\n" + "plain words of no account " * 60 + "\n").join([garbled.garble(many, one)] * 30),
        broken,
        "Is it so? Yes. WHY? BECAUSE. " * 20,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    got = {r.k: r for r in garbled.find_garbled(df, ["k"], "content", model).collect()}
    assert sorted(got) == [0, 1, 2]
    assert not got[0].lossless and got[1].restored == ("\n" + "plain words of no account " * 60 + "\n").join([many] * 30) and got[2].restored == han
    assert "".join(model.parts(broken, 5000)) == broken
    assert "".join(model.parts(texts[1], 5000)) == texts[1] and len(model.parts(texts[1], 5000)) > 5


def test_scan_is_the_best_stretch(model):
    """The scan over telling bigrams against a plain one over all."""
    rng = random.Random(8)
    for _ in range(40):
        t = "".join(rng.choice(["Ã©", "é", "a", "plain words ", "?", "中", "Ð°", "\n"]) for _ in range(rng.randrange(1, 80)))
        sums = model.ratio[:, garbled.bigrams(t)].cumsum(axis=1, dtype="f8")
        best = {c: max((row[j] - (row[i - 1] if i else 0) for i in range(len(row)) for j in range(i, len(row))), default=0) for c, row in enumerate(sums)}
        got = {c: s for s, c, _, _ in model.scan(t)}
        assert {c for c, s in best.items() if s >= garbled.CONFIRMED + 1e-3} <= set(got)
        assert all(abs(best[c] - s) < 1e-3 for c, s in got.items())


def test_every_chain_inverts_strictly():
    for chain in garbled.CHAINS:
        if chain[1] == "utf-8" or chain[0] == chain[1]:
            assert garbled.invert("é", chain) is None
    assert garbled.invert("Ã©Ã", ("utf-8", "cp1252", 1)) is None
    assert garbled.invert("Ã©", ("utf-8", "cp1252", 1)) == "é"


def test_table(spark, rows, model):
    df = spark.createDataFrame(
        [(1, 1, "El niÃ±o perdiÃ³ el paraguas en la estaciÃ³n.", "x"), (1, 1, "El niÃ±o perdiÃ³ el paraguas en la estaciÃ³n.", "x"), (2, 1, "El niño perdió el paraguas en la estación.", "x"), (3, 1, None, "x"), (4, 1, "", "x"), (5, 1, "El ni�o perdi� el paraguas.", "x"), (6, 1, "plain text " * 9000 + "El niÃ±o perdiÃ³ el paraguas en la estaciÃ³n.", "x"), (7, 1, "NÃO MOVER A PASTA 4 ATÉ A REVISÃO.", "x")],
        "file_id bigint, generation bigint, content string, chains string",
    )
    got = rows(garbled.find_garbled(df, ["file_id", "generation"], "content", model), "file_id", "restored", "lossless")
    assert [r[0] for r in got] == [1, 5, 6]
    assert got[0][1:] == ("El niño perdió el paraguas en la estación.", True) and got[1][2] is False and got[2][1].endswith("estación.") and len(got[2][1]) > 90_000
    assert garbled.find_garbled(df.limit(0), ["file_id", "generation"], "content").count() == 0
