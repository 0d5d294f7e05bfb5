"""Queries of the general pipeline problems 2, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import clean_path
from tidemark.operators import changefeed, incremental, tablediff
from tidemark.sources.tables import table

STATE = ["file_id", "generation", "mtime_ns"]


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    items = incremental.current_rows(table(spark, d, "files"), keep=["file_id", "generation", "mtime_ns"])
    runs = table(spark, d, "index_runs")
    now = runs.agg(F.max(F.greatest("started_at", "finished_at"))).first()[0]  # one value: the last thing that is known to have happened
    return incremental.replay(items, table(spark, d, "run_log"), runs, STATE, F.lit(now).cast("timestamp_ntz"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).where("state <> 'done'").select("file_id")


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).select(*STATE, "state", "token")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    fields = ["size", "mtime_ns", "inode"]
    catalog = incremental.current_rows(table(spark, d, "files"), keep=["file_id", "generation", "path_key", "status", *fields]).where("status <> 'deleted'")
    disk = table(spark, d, "file_snapshots").select(clean_path("path").alias("path_key"), *fields)
    return tablediff.diff_tables(catalog, disk, "path_key", fields, "files", "snapshot")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("path_key", "field")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "mutations")).select("file_id", "generation", "seq")


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "mutations"))


QUERIES = {q.__name__: q for q in (p2_found, p2_ledger, p5_found, p5_values, p6_found, p6_state)}

_CURRENT = "cur AS (SELECT DISTINCT f.* FROM (SELECT file_id, max(generation) AS g FROM files GROUP BY file_id) m JOIN files f ON f.file_id = m.file_id AND f.generation = m.g)"
_CLEAN = """CASE WHEN list_reduce(list_prepend('', string_split(path, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) = '' THEN '/'
 ELSE list_reduce(list_prepend('', string_split(path, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) END"""
_SIDES = f"""WITH {_CURRENT},
l AS (SELECT DISTINCT path_key, size, mtime_ns, inode FROM cur WHERE status <> 'deleted'),
r AS (SELECT DISTINCT {_CLEAN} AS path_key, size, mtime_ns, inode FROM file_snapshots),
j AS (SELECT coalesce(l.path_key, r.path_key) AS path_key, l.path_key AS lk, r.path_key AS rk, l.size AS ls, r.size AS rs, l.mtime_ns AS lm, r.mtime_ns AS rm, l.inode AS li, r.inode AS ri FROM l FULL JOIN r ON l.path_key = r.path_key),
d AS (SELECT path_key, 'only_in_files' AS field, NULL::VARCHAR AS left_value, NULL::VARCHAR AS right_value FROM j WHERE rk IS NULL
 UNION ALL SELECT path_key, 'only_in_snapshot', NULL, NULL FROM j WHERE lk IS NULL
 UNION ALL SELECT path_key, 'size', ls::VARCHAR, rs::VARCHAR FROM j WHERE lk = rk AND ls IS DISTINCT FROM rs
 UNION ALL SELECT path_key, 'mtime_ns', lm::VARCHAR, rm::VARCHAR FROM j WHERE lk = rk AND lm IS DISTINCT FROM rm
 UNION ALL SELECT path_key, 'inode', li::VARCHAR, ri::VARCHAR FROM j WHERE lk = rk AND li IS DISTINCT FROM ri)"""
_OPEN = f"""WITH {_CURRENT},
w AS (SELECT r.file_id, r.generation, r.mtime_ns, max(CASE WHEN i.state = 'succeeded' THEN 1 ELSE 0 END) AS won, max(r.run_id * 1048576 + r.attempt) AS token,
 max(CASE WHEN i.state = 'running' AND i.started_at + INTERVAL 1 HOUR > n.now THEN 1 ELSE 0 END) AS held
 FROM (SELECT max(greatest(started_at, finished_at)) AS now FROM index_runs) n, run_log r LEFT JOIN index_runs i ON r.run_id = i.run_id AND r.attempt = i.attempt GROUP BY r.file_id, r.generation, r.mtime_ns),
s AS (SELECT cur.file_id, cur.generation, cur.mtime_ns, CASE WHEN w.won = 1 THEN 'done' WHEN w.held = 1 THEN 'leased' ELSE 'pending' END AS state, coalesce(w.token, 0)::BIGINT AS token
 FROM cur LEFT JOIN w ON cur.file_id = w.file_id AND cur.generation = w.generation AND cur.mtime_ns = w.mtime_ns)"""
_FEED = """WITH ok AS (SELECT DISTINCT * FROM mutations WHERE file_id >= 1 AND generation >= 1 AND ((kind = 'upsert' AND path <> '') OR (kind = 'delete' AND path IS NULL))),
t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY generation DESC, seq DESC) AS rn FROM ok),
g AS (SELECT file_id, max(seq) FILTER (kind = 'delete') AS gone FROM (SELECT *, max(generation) OVER (PARTITION BY file_id) AS mg FROM ok) WHERE generation = mg GROUP BY file_id)"""
SQL = {
    "p2_found": f"{_OPEN} SELECT file_id FROM s WHERE state <> 'done'",
    "p2_ledger": f"{_OPEN} SELECT * FROM s",
    "p5_found": f"{_SIDES} SELECT path_key, field FROM d",
    "p5_values": f"{_SIDES} SELECT * FROM d",
    "p6_found": f"{_FEED} SELECT file_id, generation, seq FROM t WHERE rn = 1 AND kind = 'upsert'",
    "p6_state": f"""{_FEED} SELECT t.file_id, t.generation, t.seq,
 (SELECT max_by(path, seq) FROM ok WHERE ok.file_id = t.file_id AND ok.generation = t.generation AND kind = 'upsert' AND path IS NOT NULL AND seq > coalesce(gone, -1)) AS path,
 (SELECT max_by(mtime_ns, seq) FROM ok WHERE ok.file_id = t.file_id AND ok.generation = t.generation AND kind = 'upsert' AND mtime_ns IS NOT NULL AND seq > coalesce(gone, -1)) AS mtime_ns,
 (SELECT max_by(status, seq) FROM ok WHERE ok.file_id = t.file_id AND ok.generation = t.generation AND kind = 'upsert' AND status IS NOT NULL AND seq > coalesce(gone, -1)) AS status
 FROM t JOIN g ON t.file_id = g.file_id WHERE rn = 1 AND kind = 'upsert'""",
}
