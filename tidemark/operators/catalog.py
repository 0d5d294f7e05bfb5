"""The file catalog: lookups, pages, upserts under a generation fence, moves and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import under_prefix

KINDS = ["text", "image", "video", "other"]
STATUSES = ["indexed", "pending", "failed", "deleted"]


def multi_get(files: DataFrame, ids: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of the ids asked for, each once; unknown ids are left out, null and non-positive ones are no ids."""
    wanted = ids.where(F.col(key) > 0).select(key).distinct()
    return files.join(wanted, key, "left_semi")


def page(files: DataFrame, prefix: str | None, after: str = "", limit: int = 1000) -> DataFrame:
    """Keyset page: rows under a prefix whose path key is strictly beyond ``after``, in order; 10000 at most."""
    return files.where(under_prefix(F.col("path_key"), prefix) & (F.col("path_key") > after)).orderBy("path_key").limit(min(max(limit, 1), 10_000))


def select(files: DataFrame, prefix: str | None = None, kinds: list[str] | None = None, mtime_from: int | None = None, mtime_to: int | None = None) -> DataFrame:
    """Catalog filters: prefix, set of kinds, inclusive mtime range. Unknown kinds and inverted ranges are errors."""
    if kinds and set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds {sorted(set(kinds) - set(KINDS))}")
    if mtime_from is not None and mtime_to is not None and mtime_from > mtime_to:
        raise ValueError("mtime range is inverted")
    out = files.where(under_prefix(F.col("path_key"), prefix)) if prefix else files
    if kinds:
        out = out.where(F.col("kind").isin(sorted(set(kinds))))
    if mtime_from is not None:
        out = out.where(F.col("mtime_ns") >= mtime_from)
    return out.where(F.col("mtime_ns") <= mtime_to) if mtime_to is not None else out


def upsert(files: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Catalog after upserts on path_key: (file_id, path_key, generation, *fields, outcome).

    A known path keeps its file_id; the other columns are replaced when the new generation is at least the
    stored one, else the row stays and is ``stale``. New paths get ids after the largest one, in path order. Of several
    new rows of a path the highest generation counts (ties: largest fields).
    """
    best = new.where("path_key IS NOT NULL").groupBy("path_key").agg(F.max(F.struct("generation", *fields)).alias("n"))
    j = files.select("file_id", "path_key", F.struct("generation", *fields).alias("o")).join(best, "path_key", "full_outer")
    fresh = F.col("file_id").isNull()
    wins = F.col("o").isNull() | (F.col("n").isNotNull() & (F.col("n.generation") >= F.col("o.generation")))
    outcome = F.when(F.col("n").isNull(), "kept").when(fresh, "inserted").when(wins, "updated").otherwise("stale")
    j = j.select("file_id", "path_key", F.when(wins, F.col("n")).otherwise(F.col("o")).alias("r"), outcome.alias("outcome"))
    added = _numbered(j.where(fresh).select("path_key", "r", "outcome"), "path_key", files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0])
    return j.where(~fresh).unionByName(added).select("file_id", "path_key", "r.generation", *[f"r.{c}" for c in fields], "outcome")


def _numbered(rows: DataFrame, order: str, after: int, name: str = "file_id") -> DataFrame:
    """``name``: contiguous numbers in the order of a column, by offsets of range partitions instead of one task."""
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    from tidemark.session import staged

    parts = staged(parts, "numbered")
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("_p").count().collect())
    start, at = {}, after
    for p, n in sizes:
        start[p] = at
        at += n
    if not start:
        return parts.select(F.lit(None).cast("long").alias(name), *rows.columns)
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    return parts.select((offset[F.col("_p")] + F.col("_i") + 1).alias(name), *rows.columns)


def relocate(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(file_id, generation, new_path, outcome) for moves (file_id, generation, new_path).

    not_found without a row; stale unless the generation is the stored one; path_ownership when another row, a deleted one
    included, owns the destination; else moved.
    """
    stored = files.select("file_id", F.col("generation").alias("g"))
    owner = files.select(F.col("path_key").alias("new_path"), F.col("file_id").alias("owner"))
    j = moves.join(stored, "file_id", "left").join(owner, "new_path", "left")
    outcome = F.when(F.col("g").isNull(), "not_found").when(F.col("g") != F.col("generation"), "stale").when(F.col("owner").isNotNull() & (F.col("owner") != F.col("file_id")), "path_ownership").otherwise("moved")
    return j.select("file_id", "generation", "new_path", outcome.alias("outcome"))


def mark_deleted(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Soft delete under the fence: status deleted, indexed_at null, same generation; other rows as they are."""
    hit = wanted.select("file_id", F.col("generation").alias("_g")).distinct()
    j = files.join(hit.select(F.col("file_id").alias("_f"), "_g"), (F.col("file_id") == F.col("_f")) & (F.col("generation") == F.col("_g")), "left").drop("_f")
    gone = F.col("_g").isNotNull()
    return j.withColumns({"status": F.when(gone, "deleted").otherwise(F.col("status")), "indexed_at": F.when(~gone, F.col("indexed_at"))}).drop("_g")


def fence(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Each request (file_id, generation) with ``fresh``, ``stale`` or ``missing`` against the catalog."""
    j = requests.join(files.select("file_id", F.col("generation").alias("_g")), "file_id", "left")
    return j.withColumn("fence", F.when(F.col("_g").isNull(), "missing").when(F.col("_g") == F.col("generation"), "fresh").otherwise("stale")).drop("_g")


def problems() -> Column:
    """Names of the rules a catalog row breaks, in a fixed order."""
    rules = {
        "path": F.col("path").isNull() | (F.col("path") == ""),
        "size": F.coalesce(F.col("size") < 0, F.lit(True)),
        "kind": ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
        "status": ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)),
        "generation": F.coalesce(F.col("generation") < 1, F.lit(True)),
        "sample_hash": F.coalesce(F.octet_length("sample_hash") != 16, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def key_collisions(files: DataFrame, path_key: Column) -> DataFrame:
    """(path_key, n): keys that several file ids would share; a back-fill is refused while there are any."""
    return files.select(path_key.alias("path_key"), "file_id").distinct().groupBy("path_key").agg(F.count("*").alias("n")).where("n > 1")


def lookup(files: DataFrame, file_id: int | None = None, path_key: str | None = None) -> DataFrame:
    """The row of an id or of a path key; empty when there is none."""
    if (file_id is None) == (path_key is None):
        raise ValueError("either an id or a path key")
    return files.where(F.col("file_id") == file_id if file_id is not None else F.col("path_key") == path_key)


class NotFound(LookupError):
    """No row has the key asked for."""


#: Keys that a row of each table is looked up by.
KEYS = {"file": [["file_id"], ["path_key"]], "task": [["task_id"]], "dead letter": [["file_id"], ["task_id"]], "note": [["note_id"]], "vector": [["file_id", "frame_idx"]]}


def point(table: DataFrame, what: str, **key) -> dict:
    """The row with a key, as a dict; NotFound without one. Of several the largest stands. ``what`` and the names of the key must be among KEYS."""
    if sorted(key) not in [sorted(k) for k in KEYS[what]]:
        raise ValueError(f"a {what} isn't looked up by {sorted(key)}")
    rows = table
    for c, x in key.items():
        rows = rows.where(F.col(c) == F.lit(x))
    row = rows.orderBy(*[F.desc(c) for c, t in rows.dtypes if not t.startswith("map")]).limit(1).collect()
    if not row:
        raise NotFound(f"{what} {key}")
    return row[0].asDict()


#: Statuses that a finished task may leave a file in (fixed values).
COMMITTED = ["indexed", "deleted"]


def bump(files: DataFrame, wanted: DataFrame, by: str = "file_id") -> DataFrame:
    """The catalog with the rows named by id or path key one generation on and pending; names without a row change nothing."""
    hit = wanted.select(F.col(by).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    j = files.join(hit, F.col(by) == F.col("_k"), "left")
    on = F.col("_hit").isNotNull()
    return j.withColumns({"generation": F.when(on, F.col("generation") + 1).otherwise(F.col("generation")), "status": F.when(on, F.lit("pending")).otherwise(F.col("status"))}).select(*files.columns)


def resolve(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, found_id): a task's row by its file_id if it has one, else by the old path of a move, else by its path; null if missing."""
    by_id = files.select(F.col("file_id").alias("_i"))
    by_path = files.select(F.col("path_key").alias("_p"), F.col("file_id").alias("_pi"))
    where = F.when(F.col("op") == "relocate", F.coalesce("old_path_key", "path_key")).otherwise(F.col("path_key"))
    j = tasks.select("task_id", "file_id", where.alias("_w")).join(by_id, F.col("file_id") == F.col("_i"), "left").join(by_path, F.col("_w") == F.col("_p"), "left")
    return j.select("task_id", F.when(F.col("file_id").isNotNull(), F.col("_i")).otherwise(F.col("_pi")).alias("found_id"))


def prepare(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, file_id, outcome) of tasks in flight (task_id, file_id, path_key, generation) about to be bound to a row.

    An anchored task needs its row, at its generation, and a path that no other row owns; one without an anchor takes the row of its path, if its
    generation is not below the stored one, or a new row.
    """
    row = files.select(F.col("file_id").alias("_i"), F.col("generation").alias("_g"))
    owner = files.select(F.col("path_key").alias("_p"), F.col("file_id").alias("_o"), F.col("generation").alias("_og"))
    j = tasks.join(row, F.col("file_id") == F.col("_i"), "left").join(owner, F.col("path_key") == F.col("_p"), "left")
    anchored = F.col("file_id").isNotNull()
    outcome = (
        F.when(anchored & F.col("_i").isNull(), "not_found")
        .when(anchored & (F.col("_g") != F.col("generation")), "stale")
        .when(anchored & F.col("_o").isNotNull() & (F.col("_o") != F.col("file_id")), "path_ownership")
        .when(~anchored & (F.col("_og") > F.col("generation")), "stale")
        .when(~anchored & F.col("_o").isNull(), "new")
        .otherwise("bound")
    )
    return j.select("task_id", F.coalesce("file_id", "_o").alias("file_id"), outcome.alias("outcome"))


def in_order(ids: DataFrame, position: str = "pos", key: str = "file_id") -> DataFrame:
    """Each id once, with its first position."""
    return ids.groupBy(key).agg(F.min(position).alias(position))
