import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import tokens

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def other():
    if not os.path.exists(JSON):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_like_the_other_library(other, spark, data):
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select("text").collect()] + ["<|endoftext|> 😀 ﬁ　x   \t\n", " ", "a  b   c\n\n d", "it's WE'LL 12345 ½²"]
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.encode(t) == e.ids
        assert tokens.decode(e.ids).decode() == t


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_parts_change_nothing(text, size):
    whole = tokens.load()[0].encode_ordinary(text)
    assert "".join(tokens.parts(text, size)) == text
    assert [i for p in tokens.parts(text, size) for i in tokens.load()[0].encode_ordinary(p)] == whole


def test_long_texts():
    rng = random.Random(0)
    t = "".join(rng.choice(["word ", "  ", "\n", "don't ", "数据", "x1", " ", "é"]) for _ in range(60_000))
    assert tokens.encode(t) == tokens.load()[0].encode_ordinary(t)
    assert tokens.decode(tokens.encode("数" * 90_000)).decode() == "数" * 90_000


def test_corpus(spark, rows):
    df = spark.createDataFrame([(1, "hi", "x"), (2, "", "x"), (3, None, "x"), (4, "  ", "x"), (4, "  ", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    got = tokens.encode_corpus(df)
    assert got.schema["ids"].dataType.simpleString() == "array<int>"
    hi, blank = tokens.encode("hi"), tokens.encode("  ")
    assert rows(got) == sorted([(1, hi), (2, []), (3, []), (4, blank), (4, blank), (None, hi)], key=repr)
    assert rows(tokens.decode_corpus(got).where("doc_id IN (1, 2)")) == [(1, "hi"), (2, "")]
    assert tokens.decode_corpus(spark.createDataFrame([(1, [255, 0]), (2, None)], "doc_id bigint, ids array<int>")).where(F.col("text").isNull()).count() >= 1
    assert tokens.encode_corpus(df.limit(0)).count() == 0
