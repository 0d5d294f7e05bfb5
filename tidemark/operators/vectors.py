"""Vector truth: validation, replacement and deletion, the change log, its replay, contracts and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FRAME, NORM_SLACK = 65_535, 1e-3
KEY = ["file_id", "frame_idx"]


def pack_key(file_id: Column, frame: Column) -> Column:
    """``file_id << 16 | frame``; null outside 1 .. 2^47 - 1 and 0 .. 65535, where the key would not fit."""
    ok = (file_id >= 1) & (file_id < (1 << 47)) & (frame >= 0) & (frame <= MAX_FRAME)
    return F.when(ok, F.shiftleft(file_id.cast("long"), 16).bitwiseOR(frame.cast("long")))


def unpack_key(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 16), key.bitwiseAND(MAX_FRAME).cast("int")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def valid_vectors(vectors: DataFrame, contracts: DataFrame) -> DataFrame:
    """(key, file_id, frame_idx, frame_ts_ms, dims, model_version, vector, norm): rows whose vector fits the model's contract, is finite and not zero; repeated rows once."""
    c = contracts.select("model_version", F.col("dims").alias("_dims")).distinct()
    v = vectors.where("vector IS NOT NULL").join(c, "model_version").where(F.size("vector") == F.col("_dims")).where(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    # equal rows share their scalar columns, so these suffice as the grouping key
    w = ["file_id", "frame_idx", "frame_ts_ms", "dims", "model_version", "vector"]
    v = v.select(*w).distinct()
    return v.select(pack_key(F.col("file_id"), F.col("frame_idx")).alias("key"), *w, norm(F.col("vector")).alias("norm"))


def problems() -> Column:
    """Names of the rules a vector row breaks, in a fixed order."""
    v = F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0)
    rules = {
        "file_id": F.coalesce(F.col("file_id") < 1, F.lit(True)),
        "frame_idx": F.coalesce((F.col("frame_idx") < 0) | (F.col("frame_idx") > MAX_FRAME), F.lit(True)),
        "frame_ts": F.coalesce(F.col("frame_ts_ms") < 0, F.lit(False)),
        "model": F.coalesce(F.trim("model_version") == "", F.lit(True)),
        "empty": ~usable,
        "dims": usable & (F.size(v) != F.col("dims")),
        "finite": usable & ~finite(v),
        "norm": usable & finite(v) & (F.abs(norm(v) - 1) > NORM_SLACK),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))


def contract_dims(vectors: DataFrame, contracts: DataFrame) -> DataFrame:
    """(model_version, n, min_dims, max_dims, contract, verdict): adopted where no contract exists and dims agree, mixed where not; else match or conflict."""
    seen = vectors.groupBy("model_version").agg(F.count("*").alias("n"), F.min("dims").alias("min_dims"), F.max("dims").alias("max_dims"))
    j = seen.join(contracts.select("model_version", F.col("dims").alias("contract")).distinct(), "model_version", "left")
    one = F.col("min_dims") == F.col("max_dims")
    verdict = F.when(F.col("contract").isNull(), F.when(one, "adopted").otherwise("mixed")).when(one & (F.col("max_dims") == F.col("contract")), "match").otherwise("conflict")
    return j.withColumn("verdict", verdict)


def replace(truth: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Truth after replacing all frames of the files in ``new`` whose generation is the catalog's; the rest of ``new`` is refused.

    new: the truth's columns and ``generation``; columns of both are those of truth.
    """
    ok = new.join(files.select("file_id", F.col("generation").alias("_g")), "file_id").where(F.col("_g") == F.col("generation")).drop("_g")
    return truth.join(ok.select("file_id").distinct(), "file_id", "left_anti").select(*truth.columns).unionByName(ok.select(*truth.columns))


def delete(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Truth without any frame of the given files."""
    return truth.join(ids.select("file_id").distinct(), "file_id", "left_anti")


def changes(old: DataFrame, new: DataFrame, after: int = 0) -> DataFrame:
    """The change log of a write: (revision, file_id, frame_idx, op). A replaced key logs its delete, then its upsert.

    Unchanged keys (equal model_version and vector) log nothing. Revisions go on from ``after`` in the order (file_id, frame_idx, delete first).
    They are numbered within ranges whose sizes are added up, not in one task.
    """
    from tidemark.operators.catalog import _numbered

    o = old.select(*KEY, F.struct("model_version", "vector").alias("o"))
    n = new.select(*KEY, F.struct("model_version", "vector").alias("n"))
    j = o.join(n, KEY, "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    ops = F.array_compact(F.array(F.when(F.col("o").isNotNull(), "delete"), F.when(F.col("n").isNotNull(), "upsert")))
    log = j.select(*KEY, F.posexplode(ops).alias("_p", "op")).withColumn("_o", F.struct(*KEY, "_p"))
    return _numbered(log, "_o", after, "revision").select("revision", *KEY, "op")


def replay(log: DataFrame) -> DataFrame:
    """(file_id, frame_idx, revision, op): the last change of each key."""
    last = log.groupBy(*KEY).agg(F.max(F.struct("revision", "op")).alias("l"))
    return last.select(*KEY, "l.revision", "l.op")


def replay_health(log: DataFrame, after: int, live: DataFrame) -> DataFrame:
    """(first, last, n, gap, tombstones, tombstone_ratio, rebuild): whether a log can be replayed after a revision.

    A gap in the revisions, or more than a fifth of tombstones, calls for a rebuild.
    """
    seen = log.where(F.col("revision") > after).agg(F.min("revision").alias("first"), F.max("revision").alias("last"), F.count("*").alias("n"))
    dead, alive = replay(log).where("op = 'delete'").count(), live.count()
    j = seen.select("*", F.lit(dead).cast("long").alias("tombstones"), F.lit(alive).cast("long").alias("alive"))
    gap = F.coalesce((F.col("first") != after + 1) | (F.col("last") - F.col("first") + 1 != F.col("n")), F.lit(False))
    ratio = F.when(F.col("alive") + F.col("tombstones") > 0, F.col("tombstones") / (F.col("alive") + F.col("tombstones"))).otherwise(F.lit(0.0))
    return j.select("first", "last", "n", gap.alias("gap"), "tombstones", F.round(ratio, 6).alias("tombstone_ratio"), (gap | (ratio > 0.2)).alias("rebuild"))


def latest_model(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """The model of the newest vector: indexed files first, then the latest indexed_at, generation and key."""
    j = vectors.join(files.select("file_id", "status", "indexed_at", "generation"), "file_id")
    return j.orderBy(F.desc(F.col("status") == "indexed"), F.desc_nulls_last("indexed_at"), F.desc("generation"), F.desc("file_id"), F.desc("frame_idx")).select("model_version").limit(1)


def late_responses(responses: DataFrame) -> DataFrame:
    """Responses (epoch, seq, model_version, dims) with a verdict in order of completion.

    One of an older dispatch than the newest seen and with another model than that one's is stale; the newest model with other dims is invalid.
    The running maximum is taken per stream of ``dependency``.
    """
    w = Window.partitionBy("dependency").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.struct("epoch", "seq", "model_version", "dims")).over(w)
    r = responses.withColumn("_t", top)
    stale = (F.col("epoch") < F.col("_t.epoch")) & (F.col("model_version") != F.col("_t.model_version"))
    bad = (F.col("model_version") == F.col("_t.model_version")) & (F.col("dims") != F.col("_t.dims"))
    return r.withColumn("verdict", F.when(stale, "stale").when(bad, "invalid").otherwise("ok")).drop("_t")


def embed_batches(frames: DataFrame, size: int = 32, lanes: int = 64) -> DataFrame:
    """(lane, batch, first_task, last_task, n): tasks of one frame packed into batches in order, per lane.

    A lane is a hash of the task, so packing is spread; batches of a lane are full but for its last.
    """
    lane = F.pmod("task_id", F.lit(lanes)).alias("lane")
    w = Window.partitionBy("lane").orderBy("task_id")
    f = frames.select(lane, "task_id").withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return f.groupBy("lane", "batch").agg(F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task"), F.count("*").alias("n"))


def pack(tasks: DataFrame, size: int = 32, lanes: int = 64) -> DataFrame:
    """(lane, batch, task_id, frames): tasks (task_id, frames) of any number of frames packed greedily, in order, per lane.

    A task is never split; one larger than ``size`` goes alone. Greedy packing is an ordered fold, so each lane, a hash of the task,
    is read in order by one task, streaming.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    rows = tasks.select(F.pmod(F.xxhash64("task_id"), F.lit(lanes)).cast("int").alias("lane"), "task_id", F.col("frames").cast("int").alias("frames")).repartition("lane").sortWithinPartitions("lane", "task_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, held = None, 0, 0
        for b in batches:
            out = []
            for lane, frames in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if lane != now:
                    now, batch, held = lane, 0, 0
                if held and held + frames > size:
                    batch, held = batch + 1, 0
                held += frames
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64()), b.column(1), b.column(2)], ["lane", "batch", "task_id", "frames"])

    return rows.mapInArrow(run, "lane int, batch bigint, task_id bigint, frames int")
