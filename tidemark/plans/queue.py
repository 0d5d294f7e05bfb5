"""Queries over the queue, dead letters, notes, commits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.paths import extension
from tidemark.functions.text import image_format, looks_binary, snippet
from tidemark.operators import catalog, directory, keyword, metrics, notes, reliability, tasks, vectors
from tidemark.plans.book import Book
from tidemark.plans.views import NOW_MS

BOOK = Book()
add = BOOK.add
_DUE = f"""due AS (SELECT * FROM {{tasks_v}} t WHERE state = 'pending' AND next_attempt_at <= {NOW_MS} AND NOT EXISTS (SELECT 1 FROM {{tasks_v}} x WHERE x.path = t.path AND x.state = 'in_flight')),
 claimable AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, task_id) AS rn FROM due) WHERE rn = 1)"""
_CLAIMED = "task_id, path, priority, attempts + claim_attempt_charge AS attempts, 'in_flight' AS state FROM claimable"
_COLS = ("task_id", "path", "priority", "attempts", "state")

add(
    "enqueue_coalesce",
    lambda v: tasks.coalesce_requests(v("requests_v")),
    """SELECT path, max(generation) AS generation, max_by(file_id, struct_pack(g := generation, s := seq)) AS file_id, max_by(op, struct_pack(g := generation, s := seq)) AS op,
 first(old_path ORDER BY generation DESC, seq DESC) AS old_path, min(priority) AS priority, min(next_attempt_at) AS next_attempt_at, count(*) AS n FROM {requests_v} GROUP BY path""",
)
add(
    "enqueue_generation",
    lambda v: tasks.allocate_generation(v("requests_v"), v("files_c").select(F.concat(F.lit("/t/"), F.col("file_id").cast("string")).alias("path_key"), "generation"), v("tasks_v")),
    """SELECT r.path, coalesce(f.generation + 1, t.g + 1, 1) AS generation FROM (SELECT DISTINCT path FROM {requests_v}) r LEFT JOIN (SELECT '/t/' || file_id AS path, generation FROM {files_c}) f ON r.path = f.path
 LEFT JOIN (SELECT path, max(generation) AS g FROM {tasks_v} GROUP BY path) t ON r.path = t.path""",
)
add("claim_topn", lambda v: tasks.claim(v("tasks_v"), NOW_MS, 200).select(*_COLS), f"WITH {_DUE} SELECT {_CLAIMED} ORDER BY priority, task_id LIMIT 200")
add("claim_fresh", lambda v: tasks.claim(v("tasks_v"), NOW_MS, 200, tasks.is_fresh()).select(*_COLS), f"WITH {_DUE} SELECT {_CLAIMED} WHERE attempts = 0 OR claim_attempt_charge = 0 ORDER BY priority, task_id LIMIT 200")
add("claim_retry", lambda v: tasks.claim(v("tasks_v"), NOW_MS, 200, ~tasks.is_fresh()).select(*_COLS), f"WITH {_DUE} SELECT {_CLAIMED} WHERE NOT (attempts = 0 OR claim_attempt_charge = 0) ORDER BY priority, task_id LIMIT 200")
add(
    "claim_fair",
    lambda v: tasks.interleave(v("tasks_v"), NOW_MS, 100),
    f"""WITH {_DUE}, s AS (SELECT task_id, source, row_number() OVER (PARTITION BY source ORDER BY priority, task_id) AS n FROM (SELECT *, CASE WHEN attempts = 0 OR claim_attempt_charge = 0 THEN 'fresh' ELSE 'retry' END AS source FROM claimable)),
 o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN source = 'retry' THEN n * 5 ELSE n + (n - 1) // 4 END, source = 'retry') AS slot FROM s WHERE n <= 100) SELECT slot, task_id, source FROM o WHERE slot <= 100""",
)
add(
    "release_due",
    lambda v: tasks.release(v("tasks_v"), NOW_MS),
    f"""WITH s AS (SELECT *, CASE WHEN state = 'pending' THEN 1 ELSE 0 END AS inn FROM {{tasks_v}} WHERE state = 'pending' OR state = 'waiting_dep' OR (state = 'retry_wait' AND next_attempt_at <= {NOW_MS}))
 SELECT path, first(task_id ORDER BY generation DESC, inn DESC, task_id) AS task_id, max(generation) AS generation, first(attempts ORDER BY generation DESC, inn DESC, task_id) AS attempts, count(*) AS n FROM s GROUP BY path""",
)
_EVENTS = ["claim", "done", "retry", "refund", "park", "dead", "release", "nonsense"]


def _events(v):
    names = F.array(*[F.lit(e) for e in _EVENTS])
    return v("tasks_v").select((F.col("task_id") + F.when(F.col("task_id") % 97 == 0, 100_000_000).otherwise(0)).alias("task_id"), names[(F.col("task_id") % 8).cast("int")].alias("event")).unionByName(v("tasks_v").select("task_id", names[(F.col("task_id") % 5).cast("int")].alias("event")))


_PAIRS = " ".join(f"WHEN state = '{s}' AND event = '{e}' THEN '{t}'" for (s, e), t in tasks.TRANSITIONS.items())
_NAMES = "[" + ", ".join(f"'{e}'" for e in _EVENTS) + "]"
add(
    "task_transitions",
    lambda v: tasks.transition(v("tasks_v"), _events(v)),
    f"""WITH ev AS (SELECT task_id + CASE WHEN task_id % 97 = 0 THEN 100000000 ELSE 0 END AS task_id, {_NAMES}[task_id % 8 + 1] AS event FROM {{tasks_v}} UNION ALL SELECT task_id, {_NAMES}[task_id % 5 + 1] FROM {{tasks_v}}),
 j AS (SELECT ev.task_id, ev.event, t.state, t.attempts, t.claim_attempt_charge AS c FROM ev LEFT JOIN {{tasks_v}} t ON ev.task_id = t.task_id),
 k AS (SELECT *, CASE {_PAIRS} END AS target FROM j)
 SELECT task_id, event, CASE WHEN state IS NULL THEN 'not_found' WHEN target IS NULL THEN 'invalid_transition' ELSE 'ok' END AS outcome, CASE WHEN target IS NOT NULL THEN target ELSE state END AS state,
 CASE WHEN target IS NULL THEN attempts WHEN event = 'claim' THEN attempts + c WHEN event IN ('retry', 'dead') THEN attempts + 1 - c WHEN event IN ('refund', 'park') THEN greatest(attempts - c, 0) ELSE attempts END AS attempts,
 CASE WHEN target IS NULL THEN c WHEN event IN ('retry', 'dead') THEN 1 WHEN event = 'park' THEN 0 ELSE c END AS claim_attempt_charge FROM k""",
)
add(
    "park_batch",
    lambda v: tasks.park(v("tasks_v"), v("tasks_v").where("state IN ('in_flight', 'done')").select("task_id", F.floor(F.col("task_id") / 4).alias("batch")).where("batch % 3 <> 0 OR task_id % 8 <> 0")),
    """WITH w AS (SELECT task_id, task_id // 4 AS batch FROM {tasks_v} WHERE state IN ('in_flight', 'done') AND (task_id // 4 % 3 <> 0 OR task_id % 8 <> 0))
 SELECT w.batch, w.task_id, bool_and(t.state = 'in_flight') OVER (PARTITION BY w.batch) AS parked FROM w JOIN {tasks_v} t ON w.task_id = t.task_id""",
)
add(
    "slot_collision",
    lambda v: tasks.slot_collisions(v("tasks_v").withColumn("path", F.concat(F.lit("/s/"), (F.col("task_id") % 701).cast("string")))),
    "SELECT path, state, task_id, rn = 1 AS keep FROM (SELECT *, row_number() OVER (PARTITION BY path, state ORDER BY generation DESC, task_id) AS rn, count(*) OVER (PARTITION BY path, state) AS n FROM (SELECT * REPLACE ('/s/' || task_id % 701 AS path) FROM {tasks_v})) WHERE n > 1",
)
add(
    "crash_recover",
    lambda v: tasks.recover(v("tasks_v")).select("task_id", "state", "crash_count", "error_class"),
    "SELECT task_id, CASE WHEN state <> 'in_flight' THEN state WHEN crash_count + 1 >= 2 THEN 'dead' ELSE 'pending' END AS state, crash_count + CASE WHEN state = 'in_flight' THEN 1 ELSE 0 END AS crash_count, CASE WHEN state = 'in_flight' THEN 'poison' END AS error_class FROM {tasks_v}",
)
add(
    "superseded",
    lambda v: tasks.superseded(v("tasks_v"), v("files_c")).select("task_id", "generation"),
    "SELECT task_id, t.generation FROM {tasks_v} t JOIN (SELECT path, max(generation) AS g FROM {tasks_v} GROUP BY path) m ON t.path = m.path LEFT JOIN {files_c} f ON t.file_id = f.file_id WHERE t.state = 'in_flight' AND (m.g > t.generation OR f.generation > t.generation)",
)
add(
    "history_merge",
    lambda v: v("tasks_v").select("task_id", F.array_join(tasks.merge_history(F.transform(F.sequence(F.lit(1), F.col("attempts") * 3 + 1), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(100), F.lit(100) + F.col("task_id") % 40), lambda i: i.cast("string"))), ",").alias("history")),
    "SELECT task_id, array_to_string(list_slice(h, greatest(len(h) - 31, 1), len(h)), ',') AS history FROM (SELECT task_id, list_concat(range(1, attempts * 3 + 2), range(100, 101 + task_id % 40)) AS h FROM {tasks_v})",
)
add(
    "backoff_schedule",
    lambda v: v("tasks_v").select("task_id", F.round(tasks.backoff_ms(F.col("attempts") - 1, 5000, 1_800_000, (F.col("task_id") % 101) / 100.0), 3).alias("delay_ms")),
    "SELECT task_id, round(greatest(least(5000.0::DOUBLE * pow(2, greatest(attempts - 1, 0)), 1800000.0) * (0.8::DOUBLE + 0.4::DOUBLE * (task_id % 101) / 100.0::DOUBLE), 1.0), 3) AS delay_ms FROM {tasks_v}",
)
_CODES = ["ENOSPC", "EACCES", "ETIMEDOUT", "file_too_large", "invalid_response", "EISDIR", "EDQUOT", "unsupported_image"]


def _errors(v):
    return v("tasks_v").select("task_id", "attempts", F.array(*[F.lit(c) for c in _CODES])[(F.col("task_id") % 8).cast("int")].alias("code"), F.array(*[F.lit(c) for c in ("io", "media", "embed")])[(F.floor(F.col("task_id") / 8) % 3).cast("int")].alias("stage"), F.when(F.col("task_id") % 50 == 0, "poison").when(F.col("task_id") % 50 == 1, "bogus").alias("explicit"))


_ERR = f"""er AS (SELECT task_id, attempts, [{", ".join(f"'{c}'" for c in _CODES)}][task_id % 8 + 1] AS code, ['io', 'media', 'embed'][task_id // 8 % 3 + 1] AS stage, CASE WHEN task_id % 50 = 0 THEN 'poison' WHEN task_id % 50 = 1 THEN 'bogus' END AS explicit FROM {{tasks_v}}),
 cl AS (SELECT *, CASE WHEN explicit IN ('transient', 'permanent', 'poison', 'fatal') THEN explicit WHEN stage = 'io' AND code IN ('file_too_large', 'not_regular', 'invalid_task') THEN 'permanent'
 WHEN stage = 'media' AND code IN ('unsupported_image', 'image_too_large', 'image_panic', 'invalid_image_config') THEN 'permanent' WHEN stage = 'embed' AND code = 'invalid_response' THEN 'permanent'
 WHEN code IN ('ENOSPC', 'EDQUOT') THEN 'fatal' WHEN code IN ('EACCES', 'EPERM', 'EUNSUPPORTED', 'EINVAL', 'EROFS', 'EFBIG', 'ENAMETOOLONG', 'ENOTDIR', 'EISDIR', 'ENOEXEC', 'ENOSYS', 'ENOTSUP', 'EOPNOTSUPP') THEN 'permanent' ELSE 'transient' END AS error_class FROM er)"""
add("error_class", lambda v: _errors(v).select("task_id", tasks.classify_error(F.col("code"), F.col("explicit"), F.col("stage")).alias("error_class")), f"WITH {_ERR} SELECT task_id, error_class FROM cl")
add("retry_decision", lambda v: _errors(v).select("task_id", tasks.retry_allowed(tasks.classify_error(F.col("code"), F.col("explicit"), F.col("stage")), F.col("attempts")).alias("again")), f"WITH {_ERR} SELECT task_id, error_class = 'transient' AND attempts < 8 AS again FROM cl")


def _versions(v):
    e, m = tasks.dead_letter_versions(F.col("stage"), F.col("extractor_version"), F.col("embed_model_version"))
    return v("dead_v").select("file_id", "stage").join(v("files_c").select("file_id", "extractor_version", "embed_model_version"), "file_id").select("file_id", e.alias("extractor_version"), m.alias("embed_model_version"))


add(
    "stage_versions",
    _versions,
    "SELECT d.file_id, CASE WHEN d.stage IN ('extract', 'worker', 'unknown') AND f.extractor_version <> '' THEN f.extractor_version END AS extractor_version, CASE WHEN d.stage IN ('embed', 'vector', 'worker', 'unknown') AND f.embed_model_version <> '' THEN f.embed_model_version END AS embed_model_version FROM {dead_v} d JOIN {files_c} f ON d.file_id = f.file_id",
)

def _bound(v):
    f = v("files_c")
    return f.select(F.col("file_id").alias("task_id"), F.when(F.col("file_id") % 3 != 0, F.col("file_id") + F.when(F.col("file_id") % 37 == 0, 50_000_000).otherwise(0)).alias("file_id"), F.when(F.col("file_id") % 5 == 0, F.concat("path_key", F.lit(".new"))).otherwise(F.col("path_key")).alias("path_key"), (F.col("generation") - F.when(F.col("file_id") % 7 == 0, 1).otherwise(0)).alias("generation"), F.when(F.col("file_id") % 4 == 0, "relocate").otherwise("upsert").alias("op"), F.when(F.col("file_id") % 8 == 0, F.col("path_key")).alias("old_path_key"))


_BOUND = """b AS (SELECT file_id AS task_id, CASE WHEN file_id % 3 <> 0 THEN file_id + CASE WHEN file_id % 37 = 0 THEN 50000000 ELSE 0 END END AS file_id, CASE WHEN file_id % 5 = 0 THEN path_key || '.new' ELSE path_key END AS path_key,
 generation - CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS generation, CASE WHEN file_id % 4 = 0 THEN 'relocate' ELSE 'upsert' END AS op, CASE WHEN file_id % 8 = 0 THEN path_key END AS old_path_key FROM {files_c})"""
add(
    "task_prepare",
    lambda v: catalog.prepare(_bound(v), v("files_c")).select("task_id", "outcome"),
    f"""WITH {_BOUND} SELECT task_id, CASE WHEN b.file_id IS NOT NULL AND f.file_id IS NULL THEN 'not_found' WHEN b.file_id IS NOT NULL AND f.generation <> b.generation THEN 'stale' WHEN b.file_id IS NOT NULL AND o.file_id <> b.file_id THEN 'path_ownership'
 WHEN b.file_id IS NULL AND o.generation > b.generation THEN 'stale' WHEN b.file_id IS NULL AND o.file_id IS NULL THEN 'new' ELSE 'bound' END AS outcome FROM b LEFT JOIN {{files_c}} f ON b.file_id = f.file_id LEFT JOIN {{files_c}} o ON b.path_key = o.path_key""",
)
add(
    "task_resolve",
    lambda v: catalog.resolve(_bound(v), v("files_c")),
    f"WITH {_BOUND} SELECT task_id, CASE WHEN b.file_id IS NOT NULL THEN f.file_id ELSE o.file_id END AS found_id FROM b LEFT JOIN {{files_c}} f ON b.file_id = f.file_id LEFT JOIN {{files_c}} o ON o.path_key = CASE WHEN b.op = 'relocate' THEN coalesce(b.old_path_key, b.path_key) ELSE b.path_key END",
)


def _finish(v, which):
    return tasks.finish(v("tasks_v"), v("tasks_v").where("task_id % 3 = 0").select("task_id"), v("dead_v"))[which]


add("tasks_finished", lambda v: _finish(v, 0).select("task_id", "state"), "WITH h AS (SELECT * FROM {tasks_v} WHERE state = 'in_flight' AND task_id % 3 = 0) SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM h) THEN 'done' ELSE state END AS state FROM {tasks_v} WHERE NOT (state = 'done' AND path IN (SELECT path FROM h))")
add("dead_letters_after_done", lambda v: _finish(v, 1).select("file_id", "generation"), "WITH h AS (SELECT file_id, max(generation) AS g FROM {tasks_v} WHERE state = 'in_flight' AND task_id % 3 = 0 GROUP BY file_id) SELECT d.file_id, d.generation FROM {dead_v} d LEFT JOIN h ON d.file_id = h.file_id WHERE h.g IS NULL OR d.generation >= h.g")


def _buried(v):
    return tasks.bury(v("tasks_v"), v("tasks_v").where("task_id % 5 = 0").select("task_id", F.lit("extract").alias("stage"), F.lit("permanent").alias("error_class")), v("files_c"), v("dead_v"), NOW_MS)


_BURY = "h AS (SELECT * FROM {tasks_v} WHERE state = 'in_flight' AND task_id % 5 = 0), n AS (SELECT file_id, max(generation) AS g FROM h GROUP BY file_id)"
add("dead_transition", lambda v: _buried(v)["tasks"].where("state = 'dead'").select("task_id", "state"), f"WITH {_BURY} SELECT task_id, 'dead' AS state FROM h")
add("dead_files_failed", lambda v: _buried(v)["files"].select("file_id", "status"), f"WITH {_BURY} SELECT f.file_id, CASE WHEN n.g = f.generation THEN 'failed' ELSE f.status END AS status FROM {{files_c}} f LEFT JOIN n ON f.file_id = n.file_id")
add("dead_letters_upserted", lambda v: _buried(v)["dead_letters"].select("file_id", "generation", "stage", "updated_at"), f"WITH {_BURY} SELECT coalesce(d.file_id, n.file_id) AS file_id, CASE WHEN n.g >= d.generation OR d.file_id IS NULL THEN n.g ELSE d.generation END AS generation, CASE WHEN n.g >= d.generation OR d.file_id IS NULL THEN 'extract' ELSE d.stage END AS stage, CASE WHEN n.g >= d.generation OR d.file_id IS NULL THEN {NOW_MS} ELSE d.updated_at END AS updated_at FROM {{dead_v}} d FULL JOIN n ON d.file_id = n.file_id")
add("dependency_probe", lambda v: tasks.probe(v("tasks_v")).select("task_id"), "SELECT task_id FROM {tasks_v} WHERE state = 'waiting_dep' ORDER BY priority, task_id LIMIT 1")
add("embed_pack", lambda v: vectors.pack(v("tasks_v").select("task_id", (F.col("attempts") * 5 + 1).alias("frames"))).groupBy("lane", "batch").agg(F.count("*").alias("tasks"), F.sum("frames").alias("frames")))

# dead letters
add("deadletters_by_class", lambda v: v("dead_v").groupBy("error_class", "stage").agg(F.count("*").alias("n")), "SELECT error_class, stage, count(*) AS n FROM {dead_v} GROUP BY ALL")
_RED = "SELECT d.file_id, d.path, coalesce(f.generation, d.generation) AS generation, 1 AS priority, CASE WHEN f.generation IS NULL THEN 'missing' WHEN f.generation > d.generation THEN 'superseded' ELSE 'enqueued' END AS outcome FROM (SELECT * REPLACE (generation - CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS generation) FROM {dead_v}) d LEFT JOIN {files_c} f ON d.file_id = f.file_id"


def _older(v):
    return v("dead_v").withColumn("generation", F.col("generation") - F.when(F.col("file_id") % 2 == 0, 1).otherwise(0))


add("redrive_by_class", lambda v: reliability.redrive(_older(v), v("files_c"), error_class="transient"), _RED + " WHERE d.error_class = 'transient'")
add("redrive_by_ids", lambda v: reliability.redrive(_older(v), v("files_c"), ids=list(range(1, 400))), _RED + " WHERE d.file_id BETWEEN 1 AND 399")
add("version_mismatch", lambda v: reliability.version_mismatch(v("dead_v"), "plain-3", "glint-v3").select("file_id", "stage"), "SELECT file_id, stage FROM {dead_v} WHERE extractor_version <> 'plain-3' OR embed_model_version <> 'glint-v3'")
add("retention_expired", lambda v: reliability.expired(v("dead_v"), NOW_MS).select("file_id", "updated_at"), f"SELECT file_id, updated_at FROM {{dead_v}} WHERE updated_at < {NOW_MS - 90 * 86_400_000}")
add("retention_kept", lambda v: reliability.forget(v("dead_v"), reliability.expired(v("dead_v"), NOW_MS)).select("file_id", "updated_at"), f"SELECT file_id, updated_at FROM {{dead_v}} WHERE updated_at >= {NOW_MS - 90 * 86_400_000}")
add(
    "failed_projection",
    lambda v: reliability.failed_projection(_older(v).where("file_id % 5 <> 0"), v("files_c")),
    """SELECT f.file_id, CASE WHEN d.generation = f.generation THEN d.path ELSE f.path_key END AS path, f.generation, '' AS content, CASE WHEN d.generation = f.generation THEN 'dead_letter' ELSE 'catalog' END AS source
 FROM {files_c} f LEFT JOIN (SELECT * REPLACE (generation - CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS generation) FROM {dead_v} WHERE file_id % 5 <> 0) d ON f.file_id = d.file_id WHERE f.status = 'failed'""",
)
add(
    "model_upgrade_batch",
    lambda v: reliability.model_upgrade_batch(v("files_c"), "glint-v3"),
    "WITH c AS (SELECT file_id, path_key, generation + 1 AS generation FROM {files_c} WHERE status = 'indexed' AND kind = 'image' AND embed_model_version IS DISTINCT FROM 'glint-v3' ORDER BY file_id LIMIT 257) SELECT *, (SELECT count(*) > 256 FROM c) AS has_more FROM c ORDER BY file_id LIMIT 256",
)
_HEAD = "CASE file_id % 4 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A00' WHEN 2 THEN '474946383961' ELSE '00' END"
add(
    "media_backfill",
    lambda v: reliability.media_backfill(v("files_c").withColumn("head_hex", F.expr(_HEAD))),
    f"SELECT file_id, path_key, generation + 1 AS generation, CASE file_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'gif' END AS format FROM {{files_c}} WHERE kind = 'other' AND status = 'indexed' AND file_id % 4 <> 3",
)

# notes
add("notes_live", lambda v: notes.live(v("notes_v"), NOW_MS).select("note_id", "file_id", "anchor_type"), f"SELECT note_id, file_id, anchor_type FROM {{notes_v}} WHERE expire_at IS NULL OR expire_at > {NOW_MS}")
add("notes_timestamp", lambda v: notes.timeline(v("notes_v"), NOW_MS).select("note_id", "file_id", "anchor_ts_ms"), f"SELECT note_id, file_id, anchor_ts_ms FROM {{notes_v}} WHERE (expire_at IS NULL OR expire_at > {NOW_MS}) AND anchor_type = 'timestamp'")
add("notes_expired", lambda v: notes.expired(v("notes_v"), NOW_MS, 500).select("note_id", "expire_at"), f"SELECT note_id, expire_at FROM {{notes_v}} WHERE expire_at <= {NOW_MS} ORDER BY expire_at, note_id LIMIT 500")
add(
    "notes_invalid",
    lambda v: v("notes_v").select("note_id", notes.invalid().alias("problem")).where("problem IS NOT NULL"),
    """SELECT note_id, CASE WHEN content IS NULL OR content = '' THEN 'content' ELSE 'anchor' END AS problem FROM {notes_v} WHERE content IS NULL OR content = ''
 OR NOT coalesce((anchor_type = 'file' AND anchor_line IS NULL AND anchor_ts_ms IS NULL) OR (anchor_type = 'line' AND anchor_line >= 1 AND anchor_ts_ms IS NULL) OR (anchor_type = 'timestamp' AND anchor_ts_ms >= 0 AND anchor_line IS NULL), false)""",
)

# commits
_REC = """r AS (SELECT r.*, f.generation = r.generation AS fresh FROM {results_v} r LEFT JOIN {files_c} f ON r.file_id = f.file_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY file_id, fresh ORDER BY seq DESC, copy DESC, op DESC) AS rn FROM r)"""
add("commit_receipts", lambda v: keyword.commit(v("results_v"), v("files_c")), f"WITH {_REC} SELECT file_id, generation, op, seq, copy, CASE WHEN NOT coalesce(fresh, false) THEN 'stale' WHEN rn = 1 THEN 'committed' ELSE 'coalesced' END AS receipt FROM k")
add("commit_coalesce", lambda v: keyword.commit(v("results_v"), v("files_c")).where("receipt = 'committed'").select("file_id", "op"), f"WITH {_REC} SELECT file_id, op FROM k WHERE fresh AND rn = 1")

# metrics
add("task_backlog", lambda v: metrics.backlog(v("tasks_v")), "SELECT state, count(*) AS n, min(created_at) AS oldest_created_at FROM {tasks_v} GROUP BY ALL")
add("oldest_pending", lambda v: metrics.oldest_pending(v("tasks_v"), NOW_MS), f"SELECT greatest({NOW_MS} - min(created_at), 0) AS age_ms FROM {{tasks_v}} WHERE state = 'pending'")
add(
    "stage_histogram",
    lambda v: metrics.histogram(v("events").select(F.col("event_type").alias("stage"), (F.col("value") / 50).alias("seconds")), "seconds", ["stage"], metrics.DOUBLING_BOUNDS),
    f"SELECT event_type AS stage, bound, count(*) FILTER (value / 50 <= bound) AS n FROM events, (SELECT unnest([{', '.join(repr(float(b)) for b in metrics.DOUBLING_BOUNDS)}, 'inf'::DOUBLE]) AS bound) WHERE value IS NOT NULL GROUP BY ALL",
)


def _root_states(v):
    r = v("snap").groupBy("root").agg(F.count("*").alias("n"))
    return r.select("root", F.when(F.col("n") % 5 == 0, "degraded").when(F.col("n") % 5 == 1, "pending").when(F.col("n") % 5 == 2, "stopped").otherwise("active").alias("state"), (F.col("n") % 2 == 0).alias("dirty"), (F.col("n") % 3).alias("epoch"), (F.col("n") % 4).alias("dirty_generation"))


_RS = "rs AS (SELECT root, CASE n % 5 WHEN 0 THEN 'degraded' WHEN 1 THEN 'pending' WHEN 2 THEN 'stopped' ELSE 'active' END AS state, n % 2 = 0 AS dirty, n % 3 AS epoch, n % 4 AS dirty_generation FROM (SELECT root, count(*) AS n FROM {snap} GROUP BY root))"
add(
    "health_rollup",
    lambda v: metrics.health(_root_states(v)),
    f"""WITH {_RS}, h AS (SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'degraded') AS degraded, count(*) FILTER (state = 'stopped') AS stopped, count(*) FILTER (dirty) AS dirty FROM rs)
 SELECT *, CASE WHEN degraded > 0 THEN 'degraded' WHEN pending > 0 THEN 'warming' WHEN dirty > 0 THEN 'degraded_dirty' ELSE 'ready' END AS status FROM h""",
)
add(
    "reconcile_triggers",
    lambda v: tasks.due_roots(_root_states(v).select("root", (F.col("state") != "pending").alias("started"), "dirty", (F.col("epoch") * 50_000_000).cast("long").alias("last_ms"), F.when(F.col("dirty_generation") == 3, NOW_MS).alias("retry_at")), 100_000_000),
    f"WITH {_RS} SELECT * FROM (SELECT root, CASE WHEN state = 'pending' THEN 'startup' WHEN dirty THEN 'dirty' WHEN epoch * 50000000 + 86400000 <= 100000000 THEN 'periodic' END AS trigger FROM rs WHERE dirty_generation <> 3) WHERE trigger IS NOT NULL",
)
add(
    "dirty_acknowledge",
    lambda v: metrics.acknowledge(_root_states(v), _root_states(v).select("root", F.col("epoch"), (F.col("dirty_generation") % 2).alias("dirty_generation"))),
    f"WITH {_RS} SELECT root, dirty_generation % 2 = dirty_generation AS cleared FROM rs",
)

# text
add("snippet", lambda v: v("docs").select("file_id", snippet(F.col("content"), F.col("status")).alias("snippet")), "SELECT file_id, CASE WHEN status = 'failed' OR content IS NULL THEN '' ELSE substr(regexp_replace(content, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), 1, 240) END AS snippet FROM {docs}")
_BIN = "CASE WHEN file_id % 7 = 0 THEN concat(content, chr(1), chr(2)) WHEN file_id % 11 = 0 THEN repeat(chr(3), 400) ELSE content END"
add(
    "binary_text",
    lambda v: v("docs").where("content IS NOT NULL").select("file_id", F.expr(_BIN).alias("c")).select("file_id", looks_binary(F.col("c")).alias("is_binary")),
    f"SELECT file_id, length(c) > 0 AND (length(c) - length(regexp_replace(c, '[\\x01-\\x07\\x0b\\x0e-\\x1f]', '', 'g'))) * 10 > length(c) AS is_binary FROM (SELECT file_id, {_BIN} AS c FROM {{docs}} WHERE content IS NOT NULL)",
)
add(
    "image_magic",
    lambda v: v("files_c").select("file_id", image_format(F.expr(_HEAD)).alias("format"), extension(F.col("path_key")).alias("ext")),
    "SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' END AS format, lower(regexp_extract(path_key, '(\\.[^./]+)$', 1)) AS ext FROM {files_c}",
)


# waits, histories, groups and counts
add(
    "watch_backoff",
    lambda v: v("tasks_v").select("task_id", tasks.step_ms(F.col("attempts"), *tasks.REOPEN_MS).alias("reopen_ms"), tasks.step_ms(F.col("attempts") - 1, *tasks.RESCAN_MS).alias("rescan_ms")),
    "SELECT task_id, least(5000::BIGINT << attempts, 300000) AS reopen_ms, least(1000::BIGINT << greatest(attempts - 1, 0), 60000) AS rescan_ms FROM {tasks_v}",
)
add(
    "attempt_entries",
    lambda v: v("tasks_v").select("task_id", tasks.attempt_entry(F.col("attempts"), F.col("next_attempt_at"), F.lit("transient"), F.col("path")).alias("entry")),
    """SELECT task_id, '[{"at_ms":' || next_attempt_at || ',"attempt":' || attempts || ',"class":"transient","error":"' || path || '"}]' AS entry FROM {tasks_v}""",
)
add(
    "active_by_path",
    lambda v: tasks.active_by_path(v("tasks_v")).withColumn("parked", F.array_join(F.transform("parked", lambda x: x.cast("string")), ",")),
    """SELECT path, max(generation) AS generation, bool_or(state = 'pending') AS pending, bool_or(state = 'in_flight') AS in_flight,
 array_to_string(list_sort(list_filter([min(task_id) FILTER (state = 'retry_wait'), min(task_id) FILTER (state = 'waiting_dep')], lambda x: x IS NOT NULL)), ',') AS parked
 FROM {tasks_v} WHERE state IN ('pending', 'in_flight', 'retry_wait', 'waiting_dep') GROUP BY path""",
)
add(
    "expansion_counts",
    lambda v: directory.expansion_counts(v("files_c").where("status <> 'deleted'").select("path_key", "generation"), v("active_v")),
    "SELECT count(*) AS matched, count(*) FILTER (path_key NOT IN (SELECT path_key FROM {active_v} WHERE state <> 'done')) AS inserted, count(*) FILTER (path_key IN (SELECT path_key FROM {active_v} WHERE state <> 'done')) AS coalesced FROM {files_c} WHERE status <> 'deleted'",
)
add(
    "generation_bump",
    lambda v: catalog.bump(v("files_c"), v("run_log").select("file_id")).select("file_id", "generation", "status"),
    "SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM run_log) THEN generation + 1 ELSE generation END AS generation, CASE WHEN file_id IN (SELECT file_id FROM run_log) THEN 'pending' ELSE status END AS status FROM {files_c}",
)
add(
    "notes_updated",
    lambda v: notes.update(v("notes_v"), v("notes_v").select("note_id", F.when(F.col("note_id") % 2 == 0, F.concat("content", F.lit("!"))).otherwise("").alias("content"), F.lit(5).cast("long").alias("expire_at"))).select("note_id", "content", "expire_at"),
    "SELECT note_id, CASE WHEN note_id % 2 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN note_id % 2 = 0 THEN 5 ELSE expire_at END AS expire_at FROM {notes_v}",
)
