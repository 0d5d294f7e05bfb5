"""Queries over change events, vectors, keywords and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import words
from tidemark.operators import debounce, keyword, search, vectors
from tidemark.plans.book import Book
from tidemark.sources import content
from tidemark.streaming import breaker

BOOK = Book()
add = BOOK.add

# debounce
_QUIET = "e AS (SELECT path_key, op, at_us, seq FROM {changes} WHERE op IN ('created', 'modified', 'removed'))"
_SESS = f"""{_QUIET}, g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY path_key ORDER BY at_us, seq) < 1000000 THEN 0 ELSE 1 END AS fresh FROM e),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY path_key ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS sn FROM g)"""
add("debounce_sessions", lambda v: debounce.sessions(v("changes")), f"WITH {_SESS} SELECT path_key, min(at_us) AS start_us, max(at_us) AS end_us, count(*) AS n FROM s GROUP BY path_key, sn")
_FOLD = " ".join(f"WHEN a = '{w}' AND x = '{n}' THEN '{t}'" for (w, n), t in debounce.MERGE.items() if w != "move")
add(
    "debounce_merge_same_path",
    lambda v: debounce.merge_same_path(v("changes")),
    f"""WITH {_SESS}, f AS (SELECT path_key, max(at_us) AS at_us, list_reduce(list(op ORDER BY at_us, seq), lambda a, x: CASE WHEN a = '' THEN x {_FOLD} END) AS op FROM s GROUP BY path_key, sn)
 SELECT * FROM f WHERE op <> ''""",
)
add("debounce_moves", lambda v: debounce.debounce(v("changes")))
add("debounce_directory", lambda v: debounce.drop_directories(debounce.debounce(v("changes")).withColumn("path", F.when(F.col("at_us") % 9 == 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))), v("files_c")))
add("change_counts", lambda v: v("changes").groupBy("root", "op").agg(F.countDistinct("seq").alias("n")), "SELECT root, op, count(DISTINCT seq) AS n FROM {changes} GROUP BY ALL")

# vectors
add("vector_norm_check", lambda v: v("vecs").select("key", F.round("norm", 4).alias("norm"), (F.abs(F.col("norm") - 1) <= vectors.NORM_SLACK).alias("unit")), "SELECT key, round(norm, 4) AS norm, abs(norm - 1) <= 0.001 AS unit FROM {vecs}")
add(
    "vector_key_pack",
    lambda v: v("vectors").select("file_id", "frame_idx", vectors.pack_key(F.col("file_id"), F.col("frame_idx")).alias("key")).distinct().select("file_id", "frame_idx", "key", vectors.unpack_key(F.col("key"))[0].alias("file_back"), vectors.unpack_key(F.col("key"))[1].alias("frame_back")),
    "SELECT DISTINCT file_id, frame_idx, (file_id << 16) | frame_idx AS key, file_id AS file_back, frame_idx AS frame_back FROM vectors",
)
_BAD = """array_to_string(list_filter([CASE WHEN vector IS NULL OR len(vector) = 0 THEN 'empty' END, CASE WHEN len(vector) > 0 AND len(vector) <> dims THEN 'dims' END, CASE WHEN len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'finite' END,
 CASE WHEN len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND abs(sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.001 THEN 'norm' END], lambda x: x IS NOT NULL), ',')"""
add("vectors_invalid", lambda v: v("vectors").select("file_id", "frame_idx", F.array_join(vectors.problems(), ",").alias("problems")).where("problems <> ''").distinct(), f"SELECT DISTINCT file_id, frame_idx, {_BAD} AS problems FROM vectors WHERE {_BAD} <> ''")
add("vector_model_versions", lambda v: v("vectors").where("model_version IS NOT NULL").select("model_version").distinct(), "SELECT DISTINCT model_version FROM vectors WHERE model_version IS NOT NULL")
add(
    "contract_dims",
    lambda v: vectors.contract_dims(v("vectors"), v("embed_model_contracts").where("model_version <> 'glint-v2'")),
    """SELECT v.model_version, n, min_dims, max_dims, c.dims AS contract, CASE WHEN c.dims IS NULL THEN CASE WHEN min_dims = max_dims THEN 'adopted' ELSE 'mixed' END WHEN min_dims = max_dims AND max_dims = c.dims THEN 'match' ELSE 'conflict' END AS verdict
 FROM (SELECT model_version, count(*) AS n, min(dims) AS min_dims, max(dims) AS max_dims FROM vectors GROUP BY ALL) v LEFT JOIN (SELECT * FROM embed_model_contracts WHERE model_version <> 'glint-v2') c ON v.model_version = c.model_version""",
)
add(
    "latest_vector_model",
    lambda v: vectors.latest_model(v("vecs"), v("files_c")),
    "SELECT model_version FROM {vecs} v JOIN {files_c} f ON v.file_id = f.file_id ORDER BY status = 'indexed' DESC, indexed_at DESC NULLS LAST, generation DESC, v.file_id DESC, frame_idx DESC LIMIT 1",
)


def _old_new(v):
    t = v("vecs").select("file_id", "frame_idx", "model_version", "vector")
    old = t.where("file_id % 3 <> 0")
    new = t.where("file_id % 5 <> 0").withColumn("model_version", F.when(F.col("file_id") % 4 == 0, "glint-v9").otherwise(F.col("model_version")))
    return old, new


_ON = """t AS (SELECT file_id, frame_idx, model_version, vector FROM {vecs}), o AS (SELECT * FROM t WHERE file_id % 3 <> 0),
 n AS (SELECT file_id, frame_idx, CASE WHEN file_id % 4 = 0 THEN 'glint-v9' ELSE model_version END AS model_version, vector FROM t WHERE file_id % 5 <> 0),
 c AS (SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.frame_idx, n.frame_idx) AS frame_idx, o.file_id IS NOT NULL AS was, n.file_id IS NOT NULL AS now FROM o FULL JOIN n ON o.file_id = n.file_id AND o.frame_idx = n.frame_idx
 WHERE o.file_id IS NULL OR n.file_id IS NULL OR o.model_version <> n.model_version OR o.vector <> n.vector),
 l AS (SELECT row_number() OVER (ORDER BY file_id, frame_idx, p) + 100 AS revision, file_id, frame_idx, op FROM (SELECT file_id, frame_idx, 0 AS p, 'delete' AS op FROM c WHERE was UNION ALL SELECT file_id, frame_idx, CASE WHEN was THEN 1 ELSE 0 END, 'upsert' FROM c WHERE now))"""
add("vector_changes", lambda v: vectors.changes(*_old_new(v), after=100), f"WITH {_ON} SELECT * FROM l")
add("replay_lww", lambda v: vectors.replay(vectors.changes(*_old_new(v), after=100)), f"WITH {_ON} SELECT file_id, frame_idx, max(revision) AS revision, max_by(op, revision) AS op FROM l GROUP BY file_id, frame_idx")
_HEALTH = """a AS (SELECT min(revision) AS first, max(revision) AS last, count(*) AS n FROM x WHERE revision > 100), d AS (SELECT count(*) FILTER (op = 'delete') AS tombstones FROM (SELECT max_by(op, revision) AS op FROM x GROUP BY file_id, frame_idx)), m AS (SELECT count(*) AS alive FROM n)
 SELECT first, last, a.n, first <> 101 OR last - first + 1 <> a.n AS gap, tombstones, round(tombstones / (alive + tombstones), 6) AS tombstone_ratio, (first <> 101 OR last - first + 1 <> a.n) OR tombstones / (alive + tombstones) > 0.2 AS rebuild FROM a, d, m"""
add("tombstone_ratio", lambda v: vectors.replay_health(vectors.changes(*_old_new(v), after=100), 100, _old_new(v)[1]), f"WITH {_ON}, x AS (SELECT * FROM l), {_HEALTH}")
add("replay_gap", lambda v: vectors.replay_health(vectors.changes(*_old_new(v), after=100).where("revision % 53 <> 0"), 100, _old_new(v)[1]), f"WITH {_ON}, x AS (SELECT * FROM l WHERE revision % 53 <> 0), {_HEALTH}")
add(
    "vector_replace",
    lambda v: vectors.replace(v("vecs").select("file_id", "frame_idx", "model_version"), v("vecs").join(v("files_c").select("file_id", F.col("generation")), "file_id").where("file_id % 4 = 0 AND frame_idx = 0").select("file_id", "frame_idx", F.lit("new").alias("model_version"), (F.col("generation") + (F.col("file_id") % 8 == 0).cast("int")).alias("generation")), v("files_c")),
    "SELECT file_id, frame_idx, model_version FROM {vecs} WHERE file_id NOT IN (SELECT file_id FROM {vecs} WHERE file_id % 8 = 4 AND frame_idx = 0) UNION ALL SELECT file_id, frame_idx, 'new' FROM {vecs} WHERE file_id % 8 = 4 AND frame_idx = 0",
)
add("vector_delete", lambda v: vectors.delete(v("vecs").select("file_id", "frame_idx"), v("files_c").where("status = 'deleted'")), "SELECT file_id, frame_idx FROM {vecs} WHERE file_id NOT IN (SELECT file_id FROM {files_c} WHERE status = 'deleted')")
add(
    "embed_batches",
    lambda v: vectors.embed_batches(v("files_c").where("kind = 'image'").select(F.col("file_id").alias("task_id")), lanes=4),
    "SELECT lane, batch, min(file_id) AS first_task, max(file_id) AS last_task, count(*) AS n FROM (SELECT file_id, file_id % 4 AS lane, (row_number() OVER (PARTITION BY file_id % 4 ORDER BY file_id) - 1) // 32 AS batch FROM {files_c} WHERE kind = 'image') GROUP BY lane, batch",
)
add(
    "late_model_responses",
    lambda v: vectors.late_responses(v("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 16).alias("dependency"), (F.col("event_id") - F.col("event_id") * 13 % 500).alias("epoch"), F.concat(F.lit("m"), (F.floor(F.col("event_id") / 1000) % 3).cast("string")).alias("model_version"), F.when(F.col("event_id") % 211 == 0, 32).otherwise(64).alias("dims"))).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("seq").alias("checksum")),
    """WITH r AS (SELECT event_id AS seq, user_id % 16 AS dependency, event_id - event_id * 13 % 500 AS epoch, 'm' || (event_id // 1000 % 3) AS model_version, CASE WHEN event_id % 211 = 0 THEN 32 ELSE 64 END AS dims FROM events),
 t AS (SELECT *, max(struct_pack(e := epoch, s := seq, m := model_version, d := dims)) OVER (PARTITION BY dependency ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM r)
 SELECT CASE WHEN epoch < t.e AND model_version <> t.m THEN 'stale' WHEN model_version = t.m AND dims <> t.d THEN 'invalid' ELSE 'ok' END AS verdict, count(*) AS n, sum(seq)::BIGINT AS checksum FROM t GROUP BY ALL""",
)

# keywords; terms of the query
TERMS = ["report", "copy", "folder"]
_WORD = "list_concat(regexp_extract_all(regexp_replace(lower({c}), '[\\p{Han}\\p{Hiragana}\\p{Katakana}]', ' ', 'g'), '[\\p{L}\\p{N}]+'), flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{Han}\\p{Hiragana}\\p{Katakana}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"


def _w(c: str) -> str:
    return _WORD.replace("{c}", c)


_TOK = f"tk AS (SELECT file_id, kind, status, path AS p, mtime_ns, coalesce({_w('filename')}, []) AS filename, coalesce({_w('path')}, []) AS path, coalesce({_w('content')}, []) AS content FROM {{docs}})"
add("tokens_df", lambda v: keyword.document_frequency(v("docs")), f"WITH tk AS (SELECT file_id, {_w('content')} AS content FROM {{docs}}), u AS (SELECT file_id, unnest(content) AS term FROM tk) SELECT term, count(DISTINCT file_id) AS df, count(*) AS tf FROM u GROUP BY term")
add("field_stats", lambda v: keyword.field_stats(v("docs")), f"WITH {_TOK} SELECT 'filename' AS field, count(*) AS docs, sum(len(filename))::BIGINT AS terms FROM tk UNION ALL SELECT 'path', count(*), sum(len(path))::BIGINT FROM tk UNION ALL SELECT 'content', count(*), sum(len(content))::BIGINT FROM tk")


def _bm25(boosts: dict[str, float], terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter({f}, lambda x: x = '{t}')) AS tf_{f}_{i}" for f in boosts for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf_{f}_{i} > 0) AS df_{f}_{i}" for f in boosts for i in range(len(terms)))
    avg = ", ".join(f"avg(len_{f}) AS avg_{f}" for f in boosts)
    score = " + ".join(f"CASE WHEN tf_{f}_{i} > 0 THEN {b}::DOUBLE * ln(1 + (n - df_{f}_{i} + 0.5::DOUBLE) / (df_{f}_{i} + 0.5::DOUBLE)) * tf_{f}_{i} * 2.2::DOUBLE / (tf_{f}_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_{f} / greatest(avg_{f}, 1e-9))) ELSE 0 END" for f, b in boosts.items() for i in range(len(terms)))
    hit = " OR ".join(f"tf_{f}_{i} > 0" for f in boosts for i in range(len(terms)))
    return f"{_TOK}, c AS (SELECT file_id, kind, status, p, mtime_ns, {', '.join(f'len({f}) AS len_{f}' for f in boosts)}, {tf} FROM tk), st AS (SELECT count(*) AS n, {avg}, {df} FROM c), sc AS (SELECT file_id, kind, status, p, mtime_ns, {score} AS score FROM c, st WHERE {hit})"


def _top(source: str, k: int) -> str:
    return f"SELECT row_number() OVER (ORDER BY round(score, 6) DESC, file_id) AS rank, file_id, round(score, 6) AS score FROM {source} ORDER BY 1 LIMIT {k}"




def _indexed(v, terms, boosts=None, keep=None):
    """Scores from the index of the documents, which is built and stored when a table is first asked."""
    stats = {r["field"]: (r["docs"], r["terms"]) for r in v("docs_stats").collect()}
    return keyword.scores(v("docs_postings"), stats, terms, boosts, keep)


add("keyword_topk", lambda v: keyword.top(_indexed(v, TERMS), 20), f"WITH {_bm25(keyword.BOOSTS, TERMS)} {_top('sc', 20)}")
_FILTER = "p LIKE '/srv/%' AND status IN ('indexed', 'failed')"
add("keyword_topk_filtered", lambda v: keyword.top(_indexed(v, TERMS, keep=v("docs").where(F.col("path").startswith("/srv/") & F.col("status").isin("indexed", "failed"))), 20), f"WITH {_bm25(keyword.BOOSTS, TERMS)}, f AS (SELECT * FROM sc WHERE {_FILTER}) {_top('f', 20)}")
add("keyword_filename_boost", lambda v: keyword.top(_indexed(v, ["note", "memo"], {"filename": 2.0, "content": 1.0}), 50), f"WITH {_bm25({'filename': 2.0, 'content': 1.0}, ['note', 'memo'])} {_top('sc', 50)}")
add(
    "postings_after_commit",
    lambda v: keyword.apply_commit(keyword.postings(v("docs"), ("filename",)), v("docs").withColumn("filename", F.upper("filename")), keyword.commit(v("results_v"), v("files_c"))).where("field = 'filename'"),
    f"""WITH tk AS (SELECT file_id, {_w('filename')} AS w FROM {{docs}}), rc AS (SELECT r.*, row_number() OVER (PARTITION BY r.file_id ORDER BY seq DESC, copy DESC, op DESC) AS rn FROM {{results_v}} r JOIN {{files_c}} f ON r.file_id = f.file_id AND r.generation = f.generation),
 gone AS (SELECT file_id FROM rc WHERE rn = 1 AND op = 'delete') SELECT term, 'filename' AS field, file_id, count(*)::INT AS tf FROM (SELECT file_id, unnest(w) AS term FROM tk WHERE file_id NOT IN (SELECT file_id FROM gone)) GROUP BY ALL""",
)

# semantic and hybrid search; the query is the vector of the model's smallest key
MODEL = "glint-v3"


def _query(v) -> list[float]:
    first = v("vecs").where(F.col("model_version") == MODEL).orderBy("key").select("vector").first()
    return list(first[0]) if first else [0.0]


_VS = f"""q AS (SELECT vector AS qv, norm AS qn FROM {{vecs}} WHERE model_version = '{MODEL}' ORDER BY key LIMIT 1),
 vs AS (SELECT key, file_id, frame_idx, frame_ts_ms, round(list_sum(list_transform(range(1, len(vector) + 1), lambda i: vector[i]::DOUBLE * qv[i]::DOUBLE)) / norm / qn, 6) AS score FROM {{vecs}}, q WHERE model_version = '{MODEL}')"""
add("vector_topk", lambda v: search.top_vectors(search.vector_scores(v("vecs"), _query(v), MODEL), 50), f"WITH {_VS} SELECT * FROM vs ORDER BY score DESC, key LIMIT 50")
add("vector_topk_per_file", lambda v: search.best_frames(search.vector_scores(v("vecs"), _query(v), MODEL)).orderBy(F.desc("score"), "file_id").limit(50), f"WITH {_VS} SELECT file_id, score, frame_idx, frame_ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, frame_idx) AS rn FROM vs) WHERE rn = 1 ORDER BY score DESC, file_id LIMIT 50")
add("semantic_eligible", lambda v: search.eligible_semantic(v("files_c"), MODEL).select("file_id"), f"SELECT file_id FROM {{files_c}} WHERE status = 'indexed' AND embed_model_version = '{MODEL}'")


def _hybrid(v, files, k=20):
    kw = _indexed(v, TERMS).withColumn("score", F.round("score", 6)).join(search.eligible_keyword(files).select("file_id"), "file_id", "left_semi")
    vec = search.vector_scores(v("vecs"), _query(v), MODEL).join(search.eligible_semantic(files, MODEL).select("file_id"), "file_id", "left_semi")
    return search.hybrid(kw, vec, k)


def _hyb(where: str) -> str:
    return f"""WITH {_bm25(keyword.BOOSTS, TERMS)}, {_VS}, ok AS (SELECT * FROM {{files_c}} WHERE {where}),
 k AS (SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM (SELECT file_id, max(round(score, 6)) AS score FROM sc WHERE file_id IN (SELECT file_id FROM ok WHERE status IN ('indexed', 'failed')) GROUP BY file_id)),
 s AS (SELECT file_id, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM (SELECT file_id, max(score) AS score FROM vs WHERE file_id IN (SELECT file_id FROM ok WHERE status = 'indexed' AND embed_model_version = '{MODEL}') GROUP BY file_id))
 SELECT coalesce(k.file_id, s.file_id) AS file_id, round(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score, least(coalesce(k.rank, s.rank), coalesce(s.rank, k.rank)) AS best_rank,
 CASE WHEN s.rank IS NULL THEN 'content' WHEN k.rank IS NULL THEN 'semantic' ELSE 'content,semantic' END AS sources FROM k FULL JOIN s ON k.file_id = s.file_id ORDER BY score DESC, best_rank, file_id LIMIT 20"""


add("hybrid_rrf", lambda v: _hybrid(v, v("files_c")), _hyb("true"))
add("hybrid_rrf_filtered", lambda v: _hybrid(v, v("files_c").where(F.col("path_key").startswith("/srv/") & (F.col("mtime_ns") > 1_600_000_000_000_000_000))), _hyb("starts_with(path_key, '/srv/') AND mtime_ns > 1600000000000000000"))


def _window(v):
    ranked = _indexed(v, TERMS).withColumn("score", F.round("score", 6)).join(v("docs").select("file_id", "path"), "file_id")
    hits, incomplete = search.window_search(ranked, F.col("path").startswith("/data/"), 20)
    return hits.select("file_id", "score", F.lit(incomplete).alias("incomplete"))


add("search_window_compat", _window)
add("query_words", lambda v: v("docs").select("file_id", F.array_join(words(F.col("filename")), " ").alias("words")), f"SELECT file_id, array_to_string({_w('filename')}, ' ') AS words FROM {{docs}}")

# dependencies and bytes
add("breaker_history", lambda v: breaker.history(v("outcomes_v").select("dependency", "seq", (F.col("seq") * 700).alias("at_ms"), "ok"), threshold=3).groupBy("dependency", "verdict", "state").agg(F.count("*").alias("n")))
add("utf8_truncate", lambda v: content.truncated(v("docs"), "file_id", "content", 100).select("file_id", "text", "truncated"))
add("sample_hash", lambda v: v("docs").where("content IS NOT NULL").select("file_id", content.sample_hash(F.col("content").cast("binary")).alias("hash")), "SELECT file_id, md5(content || '|' || strlen(content)) AS hash FROM {docs} WHERE content IS NOT NULL")
add("sniff", lambda v: v("docs").select("file_id", F.octet_length(content.sniff(F.col("content").cast("binary"))).alias("head_bytes")), "SELECT file_id, CASE WHEN content IS NOT NULL THEN least(strlen(content), 8192)::INT END AS head_bytes FROM {docs}")
