"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import garbled, leakage, neighbours, runs, subjects, tokens
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"), table(spark, d, "embed_model_contracts")).select("key_a", "key_b")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "vectors"), table(spark, d, "embed_model_contracts"))


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    graph, reps, base = neighbours.build_graph(table(spark, d, "vectors"), table(spark, d, "embed_model_contracts"))
    return neighbours.search_rows(graph, reps, base, lambda key: F.shiftright(key, 16) % 100 == 0)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(runs.canonical_changes(table(spark, d, "raw_changes")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n >= 2").select("path_key", "min_seq", "max_seq")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("path_key", "op", "old_key", "min_seq", "max_seq", "n", "duration_us")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(table(spark, d, "text_docs"), ["file_id", "generation"], "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("file_id", "generation").distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_samples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("docs"), F.avg("share").alias("mean_share"))


QUERIES = {q.__name__: q for q in (p1_found, p1_neighbours, p1_search, p3_found, p3_collapsed, p4_found, p4_restored, p7_ids, p8_found, p9_found, p9_composition)}


def _clean(c: str) -> str:
    fold = f"list_reduce(list_prepend('', string_split({c}, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
    return f"CASE WHEN {fold} = '' THEN '/' ELSE {fold} END"


_RUNS = f"""WITH e AS (SELECT DISTINCT {_clean("path")} AS path_key, lower(trim(op, E' \\t\\n\\r')) AS op, CASE WHEN old_path IS NOT NULL THEN {_clean("old_path")} END AS old_key, epoch_us(at_ts) AS t, seq FROM raw_changes WHERE at_ts IS NOT NULL),
s AS (SELECT *, CASE WHEN lag(op) OVER w IS NOT DISTINCT FROM op AND lag(old_key) OVER w IS NOT DISTINCT FROM old_key AND t - lag(t) OVER w <= 2000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path_key ORDER BY t, seq)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY path_key ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
g AS (SELECT path_key, any_value(op) AS op, any_value(old_key) AS old_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n, max(t) - min(t) AS duration_us FROM r GROUP BY path_key, run)"""
SQL = {
    "p3_found": f"{_RUNS} SELECT path_key, min_seq, max_seq FROM g WHERE n >= 2",
    "p3_collapsed": f"{_RUNS} SELECT * FROM g",
}
