"""Queries over the catalog, reconciliation and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import catalog, directory, reconcile
from tidemark.plans.book import Book

BOOK = Book()
add = BOOK.add
PREFIX = "/srv/vault"
_UNDER = f"(path_key = '{PREFIX}' OR starts_with(path_key, '{PREFIX}/') OR starts_with(path_key, '{PREFIX}\\'))"
_UP = "list_transform(range(2, len(string_split({p}, '/'))), lambda n: array_to_string(list_slice(string_split({p}, '/'), 1, n), '/'))"


def _up(p: str) -> str:
    return _UP.replace("{p}", p)


add("files_by_status", lambda v: v("files_c").groupBy("status", "kind").agg(F.count("*").alias("n")), "SELECT status, kind, count(*) AS n FROM {files_c} GROUP BY ALL")
add("files_list_failed", lambda v: v("files_c").where("status = 'failed'").select("file_id", "path_key", "generation"), "SELECT file_id, path_key, generation FROM {files_c} WHERE status = 'failed'")
add("files_prefix_page", lambda v: catalog.page(v("files_c"), PREFIX, PREFIX + "/b").select("file_id", "path_key"), f"SELECT file_id, path_key FROM {{files_c}} WHERE {_UNDER} AND path_key > '{PREFIX}/b' ORDER BY path_key LIMIT 1000")
add(
    "files_multi_get",
    lambda v: catalog.multi_get(v("files_c"), v("run_log").select("file_id")).select("file_id", "path_key", "generation", "status"),
    "SELECT file_id, path_key, generation, status FROM {files_c} WHERE file_id IN (SELECT file_id FROM run_log WHERE file_id > 0)",
)
add("prefix_boundary", lambda v: v("files_c").where(paths.under_prefix(F.col("path_key"), PREFIX + "/Q1")).select("path_key"), f"SELECT path_key FROM {{files_c}} WHERE path_key = '{PREFIX}/Q1' OR starts_with(path_key, '{PREFIX}/Q1/')")
add("kind_filter", lambda v: catalog.select(v("files_c"), kinds=["image", "video", "image"]).select("file_id", "kind"), "SELECT file_id, kind FROM {files_c} WHERE kind IN ('image', 'video')")
_LO, _HI = 1_500_000_000_000_000_000, 1_600_000_000_000_000_000
add("mtime_range", lambda v: catalog.select(v("files_c"), PREFIX, mtime_from=_LO, mtime_to=_HI).select("file_id", "mtime_ns"), f"SELECT file_id, mtime_ns FROM {{files_c}} WHERE {_UNDER} AND mtime_ns BETWEEN {_LO} AND {_HI}")
add(
    "files_invalid",
    lambda v: v("files").withColumns({"size": F.when(F.col("file_id") % 41 == 0, -F.col("size")).otherwise(F.col("size")), "kind": F.when(F.col("file_id") % 43 == 0, F.upper("kind")).otherwise(F.col("kind")), "generation": F.when(F.col("file_id") % 47 == 0, 0).otherwise(F.col("generation"))}).select("file_id", "generation", F.array_join(catalog.problems(), ",").alias("problems")).where("problems <> ''").distinct(),
    """SELECT DISTINCT file_id, generation, problems FROM (SELECT file_id, generation, array_to_string(list_filter([CASE WHEN path IS NULL OR path = '' THEN 'path' END, CASE WHEN size IS NULL OR size < 0 THEN 'size' END,
 CASE WHEN kind IS NULL OR kind NOT IN ('text', 'image', 'video', 'other') THEN 'kind' END, CASE WHEN status IS NULL OR status NOT IN ('indexed', 'pending', 'failed', 'deleted') THEN 'status' END,
 CASE WHEN generation IS NULL OR generation < 1 THEN 'generation' END, CASE WHEN octet_length(sample_hash) <> 16 THEN 'sample_hash' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT * REPLACE (CASE WHEN file_id % 41 = 0 THEN -size ELSE size END AS size, CASE WHEN file_id % 43 = 0 THEN upper(kind) ELSE kind END AS kind, CASE WHEN file_id % 47 = 0 THEN 0 ELSE generation END AS generation) FROM files)) WHERE problems <> ''""",
)
add("path_keys", lambda v: v("files").select("path", paths.clean_path("path").alias("cleaned")).distinct(), "SELECT DISTINCT path, path_key AS cleaned FROM files")
add("path_key_collisions", lambda v: catalog.key_collisions(v("files"), F.lower(F.regexp_replace("path_key", "-[^/]*$", ""))), "SELECT lower(regexp_replace(path_key, '-[^/]*$', '')) AS path_key, count(DISTINCT file_id) AS n FROM files GROUP BY 1 HAVING count(DISTINCT file_id) > 1")
add(
    "redacted_paths",
    lambda v: v("files_c").select("file_id", paths.redact(F.col("path_key")).alias("redacted")),
    "SELECT file_id, 'sha256:' || sha256(path_key) || CASE WHEN length(regexp_extract(string_split(path_key, '/')[-1], '^.+(\\.[^.]*)$', 1)) <= 16 THEN regexp_extract(string_split(path_key, '/')[-1], '^.+(\\.[^.]*)$', 1) ELSE '' END AS redacted FROM {files_c}",
)
_EXT = ", ".join(f"'{e}'" for e in text.TEXT_EXTENSIONS)
_NAMES = ", ".join(f"'{e}'" for e in text.TEXT_NAMES)
add(
    "plaintext_match",
    lambda v: v("files_c").where(text.text_file(F.col("path_key"))).select("file_id"),
    f"SELECT file_id FROM {{files_c}} WHERE regexp_extract(lower(string_split(path_key, '/')[-1]), '(\\.[^./]+)$', 1) IN ({_EXT}) OR lower(string_split(path_key, '/')[-1]) IN ({_NAMES})",
)
add(
    "sample_hash_dups",
    lambda v: v("files_c").where("sample_hash IS NOT NULL AND status <> 'deleted'").groupBy(F.lower(F.hex("sample_hash")).alias("hash")).agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1"),
    "SELECT lower(hex(sample_hash)) AS hash, count(*) AS n, min(file_id) AS first_id FROM {files_c} WHERE sample_hash IS NOT NULL AND status <> 'deleted' GROUP BY ALL HAVING count(*) > 1",
)

# upserts, fences, moves, deletes
add(
    "catalog_upsert",
    lambda v: catalog.upsert(v("files_c"), v("files").where("file_id % 3 = 0").select("path_key", (F.col("generation") + F.col("file_id") % 2).alias("generation"), "size").unionByName(v("snap").select("path_key", F.lit(1).cast("long").alias("generation"), "size")), ["size"]),
    """WITH n AS (SELECT path_key, max(struct_pack(g := generation, s := size)) AS x FROM (SELECT path_key, generation + file_id % 2 AS generation, size FROM files WHERE file_id % 3 = 0 UNION ALL SELECT path_key, 1, size FROM {snap}) GROUP BY path_key),
 j AS (SELECT coalesce(f.path_key, n.path_key) AS path_key, f.file_id, f.generation AS og, f.size AS os, n.path_key AS np, n.x.g AS ng, n.x.s AS ns FROM {files_c} f FULL JOIN n ON f.path_key = n.path_key),
 k AS (SELECT *, file_id IS NULL AS fresh, og IS NULL OR (np IS NOT NULL AND ng >= og) AS wins FROM j)
 SELECT CASE WHEN fresh THEN (SELECT max(file_id) FROM {files_c}) + row_number() OVER (PARTITION BY fresh ORDER BY path_key) ELSE file_id END AS file_id, path_key, CASE WHEN wins THEN ng ELSE og END AS generation, CASE WHEN wins THEN ns ELSE os END AS size,
 CASE WHEN np IS NULL THEN 'kept' WHEN fresh THEN 'inserted' WHEN wins THEN 'updated' ELSE 'stale' END AS outcome FROM k""",
)
add(
    "generation_fence",
    lambda v: catalog.fence(v("files").select("file_id", "generation").distinct(), v("files_c")),
    "SELECT r.file_id, r.generation, CASE WHEN f.file_id IS NULL THEN 'missing' WHEN f.generation = r.generation THEN 'fresh' ELSE 'stale' END AS fence FROM (SELECT DISTINCT file_id, generation FROM files) r LEFT JOIN {files_c} f ON r.file_id = f.file_id",
)
add(
    "relocate_owner_conflict",
    lambda v: catalog.relocate(v("files_c"), v("files_c").select((F.col("file_id") + F.when(F.col("file_id") % 19 == 0, 10_000_000).otherwise(0)).alias("file_id"), (F.col("generation") + (F.col("file_id") % 23 == 0).cast("int")).alias("generation"), F.concat("path_key", F.when(F.col("file_id") % 2 == 0, ".moved").otherwise("")).alias("new_path"))),
    """WITH m AS (SELECT file_id + CASE WHEN file_id % 19 = 0 THEN 10000000 ELSE 0 END AS file_id, generation + CASE WHEN file_id % 23 = 0 THEN 1 ELSE 0 END AS generation, path_key || CASE WHEN file_id % 2 = 0 THEN '.moved' ELSE '' END AS new_path FROM {files_c})
 SELECT m.file_id, m.generation, m.new_path, CASE WHEN f.file_id IS NULL THEN 'not_found' WHEN f.generation <> m.generation THEN 'stale' WHEN o.file_id <> m.file_id THEN 'path_ownership' ELSE 'moved' END AS outcome
 FROM m LEFT JOIN {files_c} f ON m.file_id = f.file_id LEFT JOIN {files_c} o ON o.path_key = m.new_path""",
)
add(
    "mark_deleted",
    lambda v: catalog.mark_deleted(v("files_c"), v("files").where("file_id % 4 = 0").select("file_id", "generation")).select("file_id", "generation", "status", "indexed_at"),
    "SELECT file_id, generation, CASE WHEN file_id % 4 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN file_id % 4 = 0 THEN NULL ELSE indexed_at END AS indexed_at FROM {files_c}",
)

# reconciliation
_CLASS = """c AS (SELECT s.path_key, f.file_id, f.generation, CASE WHEN f.file_id IS NULL THEN 'added' WHEN s.size IS NOT DISTINCT FROM f.size AND s.mtime_ns IS NOT DISTINCT FROM f.mtime_ns AND s.inode IS NOT DISTINCT FROM f.inode AND f.status IN ('indexed', 'failed') THEN 'unchanged' ELSE 'modified' END AS outcome,
 s.size, s.mtime_ns, s.inode FROM (SELECT DISTINCT path_key, size, mtime_ns, inode FROM {snap}) s LEFT JOIN {files_c} f ON s.path_key = f.path_key),
 gone AS (SELECT * FROM {files_c} WHERE status <> 'deleted' AND path_key NOT IN (SELECT path_key FROM {snap})),
 ident AS (SELECT size, mtime_ns, inode, count(*) AS n, CASE WHEN count(*) = 1 THEN min(file_id) END AS file_id, CASE WHEN count(*) = 1 THEN min(path_key) END AS old_path_key FROM {files_c} WHERE status <> 'deleted' AND inode IS NOT NULL GROUP BY ALL)"""
add("reconcile_diff", lambda v: reconcile.classify(v("snap"), v("files_c")), f"WITH {_CLASS} SELECT * FROM c")
add("reconcile_removed", lambda v: reconcile.removed(v("snap"), v("files_c")).select("file_id", "path_key", "generation"), f"WITH {_CLASS} SELECT file_id, path_key, generation FROM gone")
add("reconcile_relocated", lambda v: reconcile.relocations(v("snap"), v("files_c")), f"WITH {_CLASS} SELECT c.path_key, i.old_path_key, i.file_id FROM c JOIN ident i ON c.size = i.size AND c.mtime_ns = i.mtime_ns AND c.inode = i.inode WHERE c.outcome = 'added' AND i.n = 1")
add("reconcile_counts", lambda v: reconcile.counts(v("snap"), v("files_c")), f"WITH {_CLASS} SELECT outcome, count(*) AS n FROM (SELECT outcome FROM c UNION ALL SELECT 'removed' FROM gone) GROUP BY ALL")
add(
    "identity_ambiguous",
    lambda v: reconcile.identities(v("files_c").select("file_id", "path_key", (F.col("size") % 9).alias("size"), F.lit(0).cast("long").alias("mtime_ns"), (F.col("inode") % 50).alias("inode"), "status")).where("n > 1").select("size", "mtime_ns", "inode", "n"),
    "SELECT size % 9 AS size, 0::BIGINT AS mtime_ns, inode % 50 AS inode, count(*) AS n FROM {files_c} WHERE status <> 'deleted' AND inode IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
)
add(
    "reconcile_covered",
    lambda v: reconcile.covered(v("files_c").select(F.when(F.col("file_id") % 14 == 0, F.concat("path_key", F.lit(".old"))).otherwise(F.col("path_key")).alias("path_key"), "generation", F.when(F.col("file_id") % 2 == 0, "remove").otherwise("upsert").alias("kind")), v("active_v")),
    """WITH d AS (SELECT CASE WHEN file_id % 14 = 0 THEN path_key || '.old' ELSE path_key END AS path_key, generation, CASE WHEN file_id % 2 = 0 THEN 'remove' ELSE 'upsert' END AS kind FROM {files_c}),
 a AS (SELECT * FROM {active_v} WHERE state <> 'done')
 SELECT * FROM d WHERE EXISTS (SELECT 1 FROM a WHERE a.path_key = d.path_key AND a.generation >= d.generation) OR (kind = 'remove' AND EXISTS (SELECT 1 FROM a WHERE a.op = 'relocate' AND a.old_path_key = d.path_key AND a.generation >= d.generation))""",
)
_ROOTS = "(SELECT DISTINCT root FROM {snap} UNION SELECT DISTINCT regexp_replace(path_key, '/[^/]*$', '') FROM {files_c})"


def _roots(v):
    return v("snap").select("root").union(v("files_c").select(F.regexp_replace("path_key", "/[^/]*$", ""))).distinct()


_OVER = f"r AS {_ROOTS}, o AS (SELECT i.root, x.root AS outer_root FROM (SELECT root, unnest({_up('root')}) AS a FROM r) i JOIN r x ON x.root = i.a)"
add("root_overlap", lambda v: reconcile.overlaps(_roots(v)), f'WITH {_OVER} SELECT root, outer_root AS "outer" FROM o')
add("nested_root_collapse", lambda v: reconcile.collapse_nested(_roots(v)), f"WITH {_OVER} SELECT root FROM r WHERE root NOT IN (SELECT root FROM o)")
add(
    "settle_check",
    lambda v: reconcile.settled(v("files_c").where("status <> 'deleted'").select("path_key", "size", "mtime_ns", "inode"), v("snap")),
    """SELECT a.path_key, CASE WHEN b.path_key IS NULL THEN 'gone' WHEN a.size > 536870912 THEN 'too_large' WHEN a.size IS NOT DISTINCT FROM b.size AND a.mtime_ns IS NOT DISTINCT FROM b.mtime_ns AND a.inode IS NOT DISTINCT FROM b.inode THEN 'settled' ELSE 'unsettled' END AS outcome
 FROM (SELECT * FROM {files_c} WHERE status <> 'deleted') a LEFT JOIN (SELECT DISTINCT path_key, size, mtime_ns, inode FROM {snap}) b ON a.path_key = b.path_key""",
)
add(
    "io_outcome",
    lambda v: v("files_c")
    .join(v("snap").select("path_key", F.struct("size", "mtime_ns", "inode").alias("s")).distinct(), "path_key", "left")
    .select(
        "file_id",
        reconcile.io_outcome(F.when(F.col("file_id") % 31 == 0, "remove").otherwise("upsert"), F.col("s").isNotNull(), F.coalesce(F.struct("size", "mtime_ns", "inode").eqNullSafe(F.col("s")), F.lit(False)), F.coalesce(F.col("size") == F.col("s.size"), F.lit(False)), F.col("file_id") % 29 == 0).alias("outcome"),
    ),
    """SELECT f.file_id, CASE WHEN f.file_id % 31 = 0 THEN 'remove' WHEN s.path_key IS NULL THEN 'remove' WHEN f.file_id % 29 = 0 AND f.size = s.size THEN 'relocate'
 WHEN f.size IS NOT DISTINCT FROM s.size AND f.mtime_ns IS NOT DISTINCT FROM s.mtime_ns AND f.inode IS NOT DISTINCT FROM s.inode THEN 'unchanged' WHEN f.size = s.size THEN 'metadata_only' ELSE 'extract' END AS outcome
 FROM {files_c} f LEFT JOIN (SELECT DISTINCT path_key, size, mtime_ns, inode FROM {snap}) s ON f.path_key = s.path_key""",
)

# directories
_DIRS = "(SELECT DISTINCT regexp_replace(path_key, '/[^/]*$', '') AS directory, CAST(1 + length(path_key) % 3 AS INT) AS priority FROM {files_c})"


def _dirs(v):
    return v("files_c").select(F.regexp_replace("path_key", "/[^/]*$", "").alias("directory"), (1 + F.length("path_key") % 3).alias("priority")).distinct()


_BELOW = f"p AS {_DIRS}, b AS (SELECT path_key, file_id, generation, unnest({_up('path_key')}) AS directory FROM {{files_c}} WHERE status <> 'deleted')"
add("directory_expand_remove", lambda v: directory.expand_remove(_dirs(v), v("files_c")), f"WITH {_BELOW} SELECT path_key, file_id, generation + 1 AS generation, min(p.priority) AS priority, 'remove' AS op FROM b JOIN p ON b.directory = p.directory GROUP BY path_key, file_id, generation")
add(
    "directory_expand_relocate",
    lambda v: directory.expand_relocate(_dirs(v).select("directory", F.concat(F.lit("/moved"), "directory").alias("destination")).distinct(), v("files_c")),
    f"WITH {_BELOW} SELECT path_key AS old_path_key, '/moved' || b.directory || '/' || substr(path_key, length(b.directory) + 2) AS path_key, file_id, generation + 1 AS generation FROM b WHERE directory IN (SELECT directory FROM p)",
)
add(
    "scope_conflicts",
    lambda v: directory.scope_conflicts(v("files_c").select(F.col("file_id").alias("task_id"), F.when(F.col("file_id") % 60 == 0, F.regexp_replace("path_key", "/[^/]*$", "")).otherwise(F.col("path_key")).alias("path"), (F.col("file_id") % 60 == 0).alias("is_dir")), v("files_c").select(F.when(F.col("file_id") % 80 == 0, F.regexp_replace("path_key", "/[^/]*$", "")).otherwise(F.col("path_key")).alias("scope"), (F.col("file_id") % 80 == 0).alias("is_dir"))),
    f"""WITH t AS (SELECT file_id AS task_id, CASE WHEN file_id % 60 = 0 THEN regexp_replace(path_key, '/[^/]*$', '') ELSE path_key END AS path, file_id % 60 = 0 AS is_dir FROM {{files_c}}),
 s AS (SELECT DISTINCT CASE WHEN file_id % 80 = 0 THEN regexp_replace(path_key, '/[^/]*$', '') ELSE path_key END AS scope, file_id % 80 = 0 AS is_dir FROM {{files_c}}),
 tu AS (SELECT task_id, unnest({_up('path')}) AS a FROM t), su AS (SELECT scope, unnest({_up('scope')}) AS a FROM s)
 SELECT task_id, scope FROM t JOIN s ON t.path = s.scope UNION SELECT task_id, scope FROM tu JOIN s ON tu.a = s.scope AND s.is_dir UNION SELECT task_id, scope FROM su JOIN t ON su.a = t.path AND t.is_dir""",
)
add(
    "removal_fence",
    lambda v: directory.removal_fence(v("snap").where(F.col("root").isin("/srv/vault", "/data/mail")).select("root"), v("files_c"), v("active_v").select(F.when(F.col("file_id") % 3 == 0, F.concat("path_key", F.lit(".new"))).otherwise(F.col("path_key")).alias("path_key"), "state", "generation")),
    f"""WITH roots AS (SELECT DISTINCT root FROM {{snap}} WHERE root IN ('/srv/vault', '/data/mail')),
 f AS (SELECT path_key, generation, unnest({_up('path_key')}) AS a FROM {{files_c}} WHERE status <> 'deleted'),
 q AS (SELECT path_key, state, generation, unnest({_up('path_key')}) AS a FROM (SELECT CASE WHEN file_id % 3 = 0 THEN path_key || '.new' ELSE path_key END AS path_key, state, generation FROM {{active_v}}))
 SELECT path_key, max(generation) + 1 AS generation, 'catalog' AS source FROM f WHERE a IN (SELECT root FROM roots) GROUP BY path_key
 UNION ALL SELECT path_key, max(generation) + 1, 'queued' FROM q WHERE a IN (SELECT root FROM roots) AND state IN ('pending', 'in_flight') AND path_key NOT IN (SELECT path_key FROM {{files_c}}) GROUP BY path_key
 UNION ALL SELECT path_key, max(generation), 'superseded' FROM q WHERE a IN (SELECT root FROM roots) AND state IN ('retry_wait', 'waiting_dep') GROUP BY path_key""",
)
add("ids_in_order", lambda v: catalog.in_order(v("run_log").select("file_id", F.col("run_id").alias("pos"))), "SELECT file_id, min(run_id) AS pos FROM run_log GROUP BY file_id")
