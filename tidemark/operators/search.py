"""Keyword, semantic and hybrid top-k over catalog filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.vectors import dot, norm
from tidemark.session import staged

RRF = 60
SOURCES = ["content", "note", "semantic"]


def eligible_keyword(files: DataFrame) -> DataFrame:
    return files.where(F.col("status").isin("indexed", "failed"))


def eligible_semantic(files: DataFrame, model: str) -> DataFrame:
    return files.where((F.col("status") == "indexed") & (F.col("embed_model_version") == model))


def vector_scores(vectors: DataFrame, query: list[float], model: str) -> DataFrame:
    """(key, file_id, frame_idx, frame_ts_ms, score): cosine of each vector of a model to the query; other models and dims take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.where((F.col("model_version") == model) & (F.size("vector") == len(query)))
    return own.select("key", "file_id", "frame_idx", "frame_ts_ms", F.round(dot(F.col("vector"), q) / norm(F.col("vector")) / norm(q), 6).alias("score"))


def top_vectors(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ties by key."""
    return scored.orderBy(F.desc("score"), "key").limit(k)


def best_frames(scored: DataFrame) -> DataFrame:
    """Each file's best frame, ties by frame: (file_id, score, frame_idx, frame_ts_ms)."""
    b = F.max(F.struct("score", (-F.col("frame_idx")).alias("f"), "frame_ts_ms")).alias("b")
    return scored.groupBy("file_id").agg(b).select("file_id", "b.score", (-F.col("b.f")).alias("frame_idx"), "b.frame_ts_ms")


def ranked(scored: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """(file_id, rank, score): ranks 1..limit after the filter and with one row a file. Only ``limit`` rows are numbered."""
    one = scored.join(files.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.max("score").alias("score"))
    cut = one.orderBy(F.desc("score"), "file_id").limit(limit)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))


def fuse(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """(file_id, score, best_rank, sources): reciprocal rank fusion; ties by best rank, then id.

    Both lists are ranked already, so the aggregation sees their limits' rows only.
    """
    both = keyword.select("file_id", "rank", F.lit("content").alias("source")).unionByName(semantic.select("file_id", "rank", F.lit("semantic").alias("source")))
    part = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, 1.0 / (RRF + F.col("rank")))), F.lit(0.0))
    named = F.array_intersect(F.array(*[F.lit(s) for s in SOURCES]), F.collect_set("source"))
    g = both.groupBy("file_id").agg((part("content") + part("semantic")).alias("score"), F.min("rank").alias("best_rank"), F.array_join(named, ",").alias("sources"))
    return g.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "best_rank", "file_id").limit(k)


def _ranks(listed: DataFrame, asked: list[tuple[int, float]]) -> dict[int, int]:
    """The rank of each asked (file_id, score) in a list: one more than the rows with a better score, or with the same and a smaller id. One pass, no sort."""
    if not asked:
        return {}
    ids, best = np.array([i for i, _ in asked]), np.array([s for _, s in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), "i8")
        for b in batches:
            i, s = b.column("file_id").to_numpy(), b.column("score").to_numpy()
            for at in range(0, len(i), 4096):
                x, y = s[at : at + 4096, None], i[at : at + 4096, None]
                n += ((x > best) | ((x == best) & (y < ids))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)), pa.int32()), pa.array(n)], ["at", "n"])

    before = listed.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return {int(ids[r["at"]]): r["n"] + 1 for r in before}


def hybrid(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """(file_id, score, best_rank, sources): reciprocal rank fusion of two lists (file_id, score) of any length, ranked whole.

    keyword and semantic hold what is eligible; of several rows of a file the best counts. A file that is beyond rank RRF + 2k in both lists
    has less than the k best of one list, so only the files up to there, a bounded number, are fused; their ranks in the other list are
    counted over all of it.
    """
    n = RRF + 2 * k + 1
    lists = [staged(x.groupBy("file_id").agg(F.max("score").alias("score")), "list") for x in (keyword, semantic)]
    tops = [[(r["file_id"], r["score"]) for r in x.orderBy(F.desc("score"), "file_id").limit(n).collect()] for x in lists]
    ranks = [{i: at + 1 for at, (i, _) in enumerate(t)} for t in tops]
    for own, other, listed in ((ranks[0], ranks[1], lists[0]), (ranks[1], ranks[0], lists[1])):
        missing = sorted(set(other) - set(own))
        if missing and len(own) == n:
            rest = [(r["file_id"], r["score"]) for r in listed.where(F.col("file_id").isin(missing)).collect()]
            own |= _ranks(listed, rest)
    spark = keyword.sparkSession
    both = [spark.createDataFrame(list(r.items()), "file_id bigint, rank int") for r in ranks]
    return fuse(*both, k)


def window_search(keyword: DataFrame, wanted: Column, k: int, hard: int = 1000) -> tuple[DataFrame, bool]:
    """Compatibility mode: looks at 4k candidates, then twice as many, up to ``hard``; (hits, incomplete).

    The ranked candidates are cut to ``hard`` + 1 once and written, so each step reads a bounded table.
    """
    cut = staged(keyword.orderBy(F.desc("score"), "file_id").limit(hard + 1), "window")
    order = cut.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))
    size, limit = cut.count(), 4 * k
    while True:
        limit = min(limit, hard)
        hits = order.where((F.col("_r") <= limit) & wanted)
        enough = hits.limit(k).count() >= k
        if enough or size <= limit or limit >= hard:
            return hits.drop("_r").orderBy(F.desc("score"), "file_id").limit(k), not enough and size > limit
        limit *= 2
