import random

from tidemark.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def brute(item, doc):
    """Longest stretch of item words within some part of the document, by edit distance over all pairs of ends."""
    n, best = len(item), 0
    for i in range(n):
        for j0 in range(len(doc) + 1):
            row = list(range(0, min(len(doc) - j0, n + n // 8 + 1) + 1))
            for k in range(i, n):
                new = [row[0] + 1]
                for c in range(1, len(row)):
                    new.append(min(row[c] + 1, new[-1] + 1, row[c - 1] + (item[k] != doc[j0 + c - 1])))
                row = new
                length = k - i + 1
                if 8 * min(row) <= length:
                    best = max(best, length)
    return best if best >= (n + 1) // 2 else 0


def test_against_brute_force():
    rng = random.Random(4)
    agreed = 0
    for _ in range(60):
        item = rng.sample(WORDS, rng.choice([3, 6, 7, 13, 17, 20]))
        part = item[rng.randrange(len(item) // 2) :][: rng.randrange(len(item) // 2, len(item) + 1)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(part)) if part else 0
            part = {0: part[:k] + ["zz"] + part[k + 1 :], 1: part[:k] + part[k + 1 :], 2: part[:k] + ["yy"] + part[k:]}[rng.randrange(3)]
        doc = rng.sample(WORDS, 6) + part + rng.sample(WORDS, 6)
        index = leakage.build_index([(1, " ".join(item))])
        got = dict(leakage.matches(index, " ".join(doc))).get(0, 0)
        want = brute(item, doc)
        assert bool(got) == bool(want), (item, doc, got, want)
        agreed += bool(want)
    assert agreed > 15


def test_replaced_middle():
    """A hit that leads nowhere doesn't hide a later stretch of the same alignment."""
    item = WORDS[:24]
    doc = item[:4] + ["zz"] * 8 + item[12:]
    index = leakage.build_index([(1, " ".join(item))])
    assert dict(leakage.matches(index, " ".join(doc))) == {0: brute(item, doc)}
    rng = random.Random(5)
    agreed = 0
    for _ in range(60):
        item = rng.sample(WORDS, rng.choice([16, 20, 24]))
        a = rng.randrange(3, 6)
        b = rng.randrange(a + 3, len(item) // 2 + 2)
        doc = rng.sample(WORDS, 3) + item[:a] + ["zz"] * (b - a) + item[b:] + rng.sample(WORDS, 3)
        want = brute(item, doc)
        assert dict(leakage.matches(leakage.build_index([(1, " ".join(item))]), " ".join(doc))).get(0, 0) == want, (item, doc)
        agreed += bool(want)
    assert agreed > 15


def test_longer_items_against_brute_force():
    """Items with shared turns of phrase, many edits, and stretches of every length."""
    rng = random.Random(12)
    agreed = 0
    for _ in range(60):
        n = rng.choice([8, 16, 24, 30, 31, 40, 52])
        item = [rng.choice(WORDS[:60]) for _ in range(n)]
        a = rng.randrange(n // 2 + 1)
        part = item[a : a + rng.randrange(n // 2 - 1, n + 1)]
        for _ in range(rng.randrange(0, max(1, len(part) // 8) + 2)):
            k = rng.randrange(len(part))
            part = {0: part[:k] + ["zz"] + part[k + 1 :], 1: part[:k] + part[k + 1 :], 2: part[:k] + ["yy"] + part[k:]}[rng.randrange(3)]
        doc = rng.sample(WORDS, 9) + part + rng.sample(WORDS, 9)
        got = dict(leakage.matches(leakage.build_index([(1, " ".join(item)), (2, " ".join(item[:5] + WORDS[100:140]))]), " ".join(doc))).get(0, 0)
        want = brute(item, doc)
        assert bool(got) == bool(want), (item, doc, got, want)
        agreed += bool(want)
    assert agreed > 15


def test_every_stretch_holds_a_run():
    for n in range(1, 200):
        for length in range(leakage.least_words(n), n + 1):
            assert -(-(length - length // 8) // (length // 8 + 1)) >= leakage.run_of(n), (n, length)


def test_scripts_without_spaces(spark, rows):
    """Items of Han and kana within longer texts, a character replaced, and Korean, which has spaces."""
    zh, ja, ko = "春天的黄河从高原流向平原带来肥沃的泥土和两岸的歌声与人们的希望一起奔向遥远的大海", "夜明けの港では漁師たちが網を直しながら沖の天気について静かに話していました", "겨울 바다는 조용하고 아이들은 모래 위에 작은 성을 쌓았다"
    assert leakage.words("北京 カナk2") == ["北", "京", "カ", "ナ", "k2"]
    items = spark.createDataFrame([(1, zh), (2, ja), (3, ko)], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "这是一篇很长的文章。" * 50 + zh + "。后面还有别的内容。"), (2, "前書き。" * 30 + ja[:25] + "、" + ja[26:] + "。終わり"), (3, "앞글 " + ko + " 뒷글"), (4, "这是一篇很长的文章。" * 50), (5, "他说：" + zh[10:34] + "……")],
        "doc_id bigint, text string",
    )
    assert rows(leakage.find_leaks(docs, items), "doc_id", "item_id") == [(1, 1), (2, 2), (3, 3), (5, 1)]


def test_stock_phrases_and_many_items(spark):
    """100,000 items that share a phrase, in one pass; a document with the phrase alone matches none."""
    rng = random.Random(2)
    phrase = "as a matter of fact"
    items = spark.createDataFrame([(i, f"{phrase} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(12))}") for i in range(100_000)], "item_id bigint, text string")
    texts = {r[0]: r[1] for r in items.where("item_id IN (5, 77777)").collect()}
    docs = spark.createDataFrame([(1, f"{phrase} nothing leaks here " * 50), (2, "before " + texts[5]), (3, texts[77777] + " after")], "doc_id bigint, text string")
    got = leakage.find_leaks(docs, items)
    assert sorted(map(tuple, got.select("doc_id", "item_id").collect())) == [(2, 5), (3, 77777)]
    assert got._jdf.queryExecution().toString().count("Union") == 0


def test_writing_does_not_matter():
    assert leakage.words("“Çà—va”,\nNaïve soft­ware​ 12!") == ["ca", "va", "naive", "software", "12"]
    assert leakage.words(None) == leakage.words("") == leakage.words(" \n—") == []


def test_tables(spark, rows):
    text = "How many minor pulleys did Lowe keep when Vatrixa inherited 116 bells after the flood"
    words = text.split()
    items = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x")], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame(
        [(1, "HOW MÁNY minor,\n> pulleys did “Lowe” keep when ... and then something else"), (2, " ".join(words[:6])), (3, None), (4, ""), (5, "lorem ipsum " * 30_000 + text + " dolor" * 30_000), (5, "lorem ipsum " * 30_000 + text + " dolor" * 30_000), (6, " ".join(words[::-1])), (7, "only two words here")],
        "doc_id bigint, text string",
    )
    assert rows(leakage.find_leaks(docs, items), "doc_id", "item_id") == [(1, 1), (5, 1), (7, 4)]
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, rows, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.sample(WORDS, 14))) for i in range(30)]
    docs = [(i, " ".join(rng.sample(WORDS, 5) + items[i % 30][1].split()[: rng.randrange(5, 15)])) for i in range(60)]
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = rows(leakage.find_leaks(a, b))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 400)
    assert rows(leakage.find_leaks(a, b)) == whole and whole
