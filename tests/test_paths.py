from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import paths


def clean(path):
    """Lexical cleaning, one segment after the other."""
    rooted, out = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part != ".." or not rooted:
            out.append(part)
    return ("/" if rooted else "") + "/".join(out) or "."


def test_cases(spark):
    cases = ["/a/b", "//a", "/a//b/", "/a/./b", "/a/../b", "/..", "/../a", "..", "../a", "a/..", "a/../..", "", "/", ".", "./a", "/a/b/../../..", "/ a /b", "/a/...", "/.hidden/x", "a//", "/ö/ß", "/a/b/.."]
    df = spark.createDataFrame([(c, clean(c)) for c in cases] + [(None, None)], "p string, want string")
    assert [(r.p, r.got) for r in df.select("p", "want", paths.clean_path("p").alias("got")).collect() if r.got != r.want] == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", ".", "..", "a", "b c", "é"]), max_size=7).map("/".join), min_size=40, max_size=60))
def test_any(spark, many):
    df = spark.createDataFrame([(c,) for c in many], "p string")
    assert {r.p: r.got for r in df.select("p", paths.clean_path("p").alias("got")).collect()} == {c: clean(c) for c in many}


def test_prefix_and_ancestors(spark):
    df = spark.createDataFrame([(p,) for p in ("C:\\foo\\a.txt", "C:\\foobar\\x", "/literal%_/a.txt", "/literalXX/a.txt", "/foo", "/foo/a", "/foobar")], "p string")
    under = lambda prefix: {r.p for r in df.where(paths.under_prefix(F.col("p"), prefix)).collect()}
    assert under("C:\\foo") == under("C:\\foo\\") == {"C:\\foo\\a.txt"}
    assert under("/literal%_") == {"/literal%_/a.txt"}
    assert under("/foo") == {"/foo", "/foo/a"} and under("/foo/") == {"/foo/a"}
    assert len(under("")) == len(under(None)) == 7
    got = df.where("p = '/foo/a'").select(paths.ancestors(F.col("p")).alias("a"), paths.relative_to(F.col("p"), F.lit("/foo")).alias("r"), paths.redact(F.lit("/x/.env")).alias("dot")).first()
    assert got.a == ["/foo"] and got.r == "a" and got.dot.startswith("sha256:") and "." not in got.dot
