"""Views the named queries run on: the current catalog, the scanned disk, and queue, dead letter and note tables derived from them.

The test data has no queue, notes or dead letters; their views are arithmetic over whole tables, in SQL
that Spark and DuckDB read alike. ``{name}`` stands for another view or table.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import clean_path
from tidemark.operators import keyword
from tidemark.operators.incremental import current_rows
from tidemark.session import shared_dir
from tidemark.sources.folder import Folder
from tidemark.sources.tables import table

NOW_MS = 1_700_002_000_000

SHARED = {
    "tasks_v": """SELECT o_orderkey + 1 AS task_id, 1 + o_orderkey % 1000 AS file_id, concat('/t/', CAST(o_orderkey - o_orderkey % 2 AS STRING)) AS path,
 CASE o_orderkey % 8 WHEN 1 THEN 'in_flight' WHEN 3 THEN 'retry_wait' WHEN 5 THEN 'waiting_dep' WHEN 7 THEN 'done' ELSE 'pending' END AS state,
 CASE o_orderkey % 3 WHEN 0 THEN 'upsert' WHEN 1 THEN 'remove' ELSE 'relocate' END AS op,
 CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderkey % 9 AS attempts, o_orderkey % 3 AS crash_count,
 CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS claim_attempt_charge, 1 + o_orderkey % 4 AS generation,
 1700000000000 + (o_orderkey % 5000) * 1000 AS next_attempt_at, 1690000000000 + o_orderkey * 1000 AS created_at FROM {orders}""",
    "requests_v": """SELECT concat('/t/', CAST(o_orderkey % 3000 AS STRING)) AS path, o_custkey AS file_id, 1 + o_custkey % 5 AS generation, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
 CASE o_orderkey % 3 WHEN 0 THEN 'upsert' WHEN 1 THEN 'remove' ELSE 'relocate' END AS op, CASE WHEN o_orderkey % 3 = 2 THEN concat('/t/old', CAST(o_orderkey AS STRING)) END AS old_path,
 1700000000000 + (o_orderkey % 5000) * 1000 AS next_attempt_at, o_orderkey AS seq FROM {orders}""",
    "dead_v": """SELECT file_id, path_key AS path, generation, CASE file_id % 4 WHEN 0 THEN 'io' WHEN 1 THEN 'extract' WHEN 2 THEN 'embed' ELSE 'worker' END AS stage,
 CASE file_id % 3 WHEN 0 THEN 'permanent' WHEN 1 THEN 'transient' ELSE 'poison' END AS error_class, CASE WHEN file_id % 4 = 1 THEN extractor_version END AS extractor_version,
 CASE WHEN file_id % 4 = 2 THEN embed_model_version END AS embed_model_version, 1690000000000 + (file_id % 200) * 86400000 AS updated_at FROM {files_c} WHERE status = 'failed'""",
    "notes_v": """SELECT doc_id + 1 AS note_id, 1 + doc_id % 977 AS file_id, CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'line' ELSE 'timestamp' END AS anchor_type,
 CASE WHEN doc_id % 3 = 1 THEN doc_id % 400 + 1 WHEN doc_id % 301 = 0 THEN 7 END AS anchor_line, CASE WHEN doc_id % 3 = 2 THEN doc_id % 90 * 1000 END AS anchor_ts_ms, source AS content,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 1700001000000 + doc_id % 2000 * 1000 END AS expire_at FROM {documents}""",
    "active_v": """SELECT path_key, generation - 1 + file_id % 3 AS generation, CASE file_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_flight' WHEN 2 THEN 'retry_wait' WHEN 3 THEN 'waiting_dep' ELSE 'done' END AS state,
 CASE WHEN file_id % 7 = 0 THEN 'relocate' ELSE 'upsert' END AS op, CASE WHEN file_id % 7 = 0 THEN concat(path_key, '.old') END AS old_path_key, file_id FROM {files_c}""",
    "results_v": """SELECT file_id, generation + CASE WHEN file_id % 11 = 0 THEN 1 WHEN file_id % 13 = 0 THEN -1 ELSE 0 END AS generation, CASE WHEN file_id % 17 = 0 THEN 'delete' ELSE 'upsert' END AS op, file_id % 3 AS copy, file_id * 3 + file_id % 3 AS seq FROM {files_c}
 UNION ALL SELECT file_id, generation, 'upsert', 9, file_id * 3 + 1 FROM {files_c} WHERE file_id % 5 = 0""",
    "outcomes_v": """SELECT event_id AS seq, CASE user_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' ELSE 'ocr' END AS dependency, CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END AS ok FROM {events}""",
}

_FILES_C = "SELECT DISTINCT f.* FROM files f JOIN (SELECT file_id, max(generation) AS g FROM files GROUP BY file_id) m ON f.file_id = m.file_id AND f.generation = m.g"


def _clean(c: str) -> str:
    fold = f"list_reduce(list_prepend('', string_split({c}, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
    return f"CASE WHEN {fold} = '' THEN '/' ELSE {fold} END"


_DUCK = {
    "files_c": _FILES_C,
    "snap": f"SELECT DISTINCT root, {_clean('path')} AS path_key, size, mtime_ns, inode FROM file_snapshots",
    "changes": f"SELECT DISTINCT root, lower(trim(op, E' \\t\\n\\r')) AS op, {_clean('path')} AS path_key, CASE WHEN old_path IS NOT NULL THEN {_clean('old_path')} END AS old_key, epoch_us(at_ts) AS at_us, seq FROM raw_changes WHERE at_ts IS NOT NULL",
    "docs": "SELECT DISTINCT t.* FROM text_docs t JOIN (SELECT file_id, max(generation) AS g FROM text_docs GROUP BY file_id) m ON t.file_id = m.file_id AND t.generation = m.g",
    "vecs": """SELECT DISTINCT (v.file_id << 16) | v.frame_idx AS key, v.file_id, v.frame_idx, v.frame_ts_ms, v.dims, v.model_version, v.vector, sqrt(list_sum(list_transform(v.vector, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
 FROM vectors v JOIN embed_model_contracts c ON v.model_version = c.model_version WHERE v.vector IS NOT NULL AND len(v.vector) = c.dims AND len(list_filter(v.vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0""",
}


def duck(sql: str) -> str:
    """DuckDB SQL in which ``{view}`` names views: they are put in front as common tables."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in SHARED or name in _DUCK:
                visit(SHARED.get(name) or _DUCK[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    names = "|".join([*SHARED, *_DUCK, "orders", "events", "documents"])
    bare = lambda text: re.sub(rf"\{{({names})\}}", r"\1", text)
    body = bare(sql)
    ctes = [f"{n} AS ({bare(SHARED.get(n) or _DUCK[n])})" for n in need]
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ", " + body.lstrip()[15:]
    return "WITH " + ",\n".join(ctes) + (", " + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else "\n" + body)


def _stored_index(spark: SparkSession, d: str) -> str:
    """The folder of the keyword index of the documents in ``d``: ``postings`` by bucket and ``stats``.

    It is built once for a state of the table, which the names, sizes and times of its files tell, and kept in the shared folder. Two that
    build it at once write each to a folder of its own; the first to finish is the one that counts.
    """
    files = Folder(spark, d)
    state = hashlib.sha256(repr(files.listing("text_docs.parquet")).encode()).hexdigest()[:24]
    home = Folder(spark, f"{shared_dir(spark)}/tidemark/keyword-{state}")
    if (named := home.read("BUILT")) is None:
        docs, mine = current_rows(table(spark, d, "text_docs")), uuid.uuid4().hex
        keyword.laid_out(keyword.index_rows(docs)).write.partitionBy("bucket").parquet(home.under(mine, "postings"))
        keyword.field_stats(docs).write.parquet(home.under(mine, "stats"))
        home.create("BUILT", mine)
        named = home.read("BUILT")
    return home.under(named)


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A view or table as a DataFrame."""
    if name in ("docs_postings", "docs_stats"):
        return spark.read.parquet(f"{_stored_index(spark, d)}/{name[5:]}")
    if name == "files_c":
        return current_rows(table(spark, d, "files"))
    if name == "docs":
        return current_rows(table(spark, d, "text_docs"))
    if name == "snap":
        return table(spark, d, "file_snapshots").select("root", clean_path("path").alias("path_key"), "size", "mtime_ns", "inode").distinct()
    if name == "changes":
        op = F.lower(F.btrim(F.col("op"), F.lit(" \t\n\x0b\f\r")))
        return table(spark, d, "raw_changes").where("at_ts IS NOT NULL").select("root", op.alias("op"), clean_path("path").alias("path_key"), clean_path("old_path").alias("old_key"), F.unix_micros(F.col("at_ts").cast("timestamp")).alias("at_us"), "seq").distinct()
    if name == "vecs":
        from tidemark.operators.vectors import valid_vectors

        return valid_vectors(table(spark, d, "vectors"), table(spark, d, "embed_model_contracts"))
    if name in SHARED:
        text = SHARED[name]
        return spark.sql(text, **{n: view(spark, d, n) for n in set(re.findall(r"\{(\w+)\}", text))})
    return table(spark, d, name)
