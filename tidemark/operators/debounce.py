"""Noisy change events folded into one action a path; the batch form of the stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US = 1_000_000
#: What a pending change and a later one of the same path make (fixed values); "" is nothing.
MERGE = {
    ("created", "created"): "created",
    ("created", "modified"): "created",
    ("created", "removed"): "",
    ("modified", "created"): "modified",
    ("modified", "modified"): "modified",
    ("modified", "removed"): "removed",
    ("removed", "created"): "modified",
    ("removed", "modified"): "modified",
    ("removed", "removed"): "removed",
    ("move", "created"): "move",
    ("move", "modified"): "move",
}
_OUT = "root string, op string, path string, old_path string, at_us bigint, due_us bigint"


@dataclass
class Pending:
    """Changes of one root that wait for their path to be quiet."""

    window: int = WINDOW_US
    by_path: dict[str, tuple[str, str | None, int]] = field(default_factory=dict)  # path -> op, old path, time; in order of putting

    def due(self, now: int | None) -> Iterator[tuple[str, str, str | None, int]]:
        """Takes out what is due at ``now`` (all if None): earliest deadline first, then the order of putting."""
        ready = [(t, i, p) for i, (p, (_, _, t)) in enumerate(self.by_path.items()) if now is None or t + self.window <= now]
        for _, _, p in sorted(ready):
            op, old, t = self.by_path.pop(p)
            yield op, p, old, t

    def add(self, op: str, path: str, old: str | None, at: int) -> None:
        if op == "move":
            before = self.by_path.pop(old, None) if old is not None else None
            if before:
                was, source, t = before
                at = max(at, t)
                op, old = ("created", None) if was == "created" else ("move", source if was == "move" else old)
            self.by_path.pop(path, None)
            self.by_path[path] = (op, old, at)
            return
        before = self.by_path.pop(path, None)
        if before is None:
            self.by_path[path] = (op, None, at)
            return
        was, source, t = before
        at = max(at, t)
        if was == "move" and op == "removed":
            # the removal is of the file that moved, unless its old path is in use again
            if source not in self.by_path:
                self.by_path[source] = ("removed", None, at)
            return
        merged = MERGE[was, op]
        if merged:
            self.by_path[path] = (merged, source if merged == "move" else None, at)


def fold(events: Iterable[tuple[str, str, str | None, int]], window: int = WINDOW_US) -> list[tuple[str, str, str | None, int]]:
    """(op, path, old path, time) flushed from a root's events in order."""
    pending, out = Pending(window), []
    for op, path, old, at in events:
        out += pending.due(at)
        pending.add(op, path, old, at)
    return out + list(pending.due(None))


def bursts(changes: DataFrame, window: int = WINDOW_US, slice_us: int = 600_000_000) -> DataFrame:
    """Changes with ``burst``: the time of the first event since the root was last quiet for a window; and ``before``, the op of the event before in the burst.

    Nothing pends over a quiet window, so bursts of a root are independent and a root with a third of all events is spread over
    many tasks. Gaps are found within slices of time; only one row a slice is needed across them.
    """
    c = changes.withColumn("_s", F.floor(F.col("at_us") / slice_us))
    inside = Window.partitionBy("root", "_s").orderBy("at_us", "seq")
    edge = c.groupBy("root", "_s").agg(F.max(F.struct("at_us", "seq", "op")).alias("_hi"))
    over = Window.partitionBy("root").orderBy("_s")
    edge = edge.withColumn("_before", F.lag("_hi").over(over))
    c = c.join(edge.select("root", "_s", "_before"), ["root", "_s"])
    c = c.withColumn("_before", F.coalesce(F.lag(F.struct("at_us", "seq", "op")).over(inside), F.col("_before")))
    new = F.coalesce(F.col("at_us") - F.col("_before.at_us") >= window, F.lit(True))
    c = c.withColumns({"_gap": F.when(new, F.col("at_us")), "before": F.when(~new, F.col("_before.op"))})
    c = c.withColumn("_start", F.last("_gap", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    tail = c.groupBy("root", "_s").agg(F.max("_gap").alias("_g"))
    tail = tail.withColumn("_carry", F.last("_g", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    return c.join(tail.select("root", "_s", "_carry"), ["root", "_s"]).withColumn("burst", F.coalesce("_start", "_carry")).drop("_s", "_before", "_gap", "_start", "_carry")


def debounce(changes: DataFrame, window: int = WINDOW_US) -> DataFrame:
    """(root, op, path, old_path, at_us, due_us): actions after all events, moves included.

    changes: root, op, path_key, old_key, at_us, seq. Order is at_us, then seq; an event exactly at a deadline finds the change flushed.
    Rows without root, path, time or a known op, and moves without an old path, are left out; repeated rows count once.
    """
    good = changes.where("root IS NOT NULL AND path_key IS NOT NULL AND at_us IS NOT NULL AND (op IN ('created', 'modified', 'removed') OR op = 'move' AND old_key IS NOT NULL)")
    rows = bursts(good.select("root", "op", "path_key", "old_key", "at_us", "seq").distinct(), window)
    rows = rows.select("root", "burst", "at_us", "seq", "op", "path_key", "old_key").repartition("root", "burst").sortWithinPartitions("root", "burst", "at_us", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pending = None, Pending(window)
        for b in batches:
            out = []
            for root, burst, at, _, op, path, old in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (root, burst) != now:
                    out += [(now[0], *x) for x in pending.due(None)] if now else []
                    now = (root, burst)
                out += [(root, *x) for x in pending.due(at)]
                pending.add(op, path, old, at)
            yield batch(out)
        if now:
            yield batch([(now[0], *x) for x in pending.due(None)])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        r, op, p, old, at = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.string()), pa.array(op, pa.string()), pa.array(p, pa.string()), pa.array(old, pa.string()), pa.array(at, pa.int64()), pa.array([t + window for t in at], pa.int64())], ["root", "op", "path", "old_path", "at_us", "due_us"])

    return rows.mapInArrow(run, _OUT)


def _still(changes: DataFrame) -> DataFrame:
    """Changes other than moves, with their path as their root."""
    c = changes.where("op IN ('created', 'modified', 'removed') AND path_key IS NOT NULL AND at_us IS NOT NULL")
    return c.select(F.col("path_key").alias("root"), "path_key", "op", F.lit(None).cast("string").alias("old_key"), "at_us", "seq").distinct()


def sessions(changes: DataFrame, window: int = WINDOW_US) -> DataFrame:
    """(path_key, start_us, end_us, n): sessions of a path, moves left out; a gap of a window or more starts a new one."""
    b = bursts(_still(changes), window)
    return b.groupBy("path_key", F.col("burst").alias("start_us")).agg(F.max("at_us").alias("end_us"), F.count("*").alias("n"))


def merge_same_path(changes: DataFrame, window: int = WINDOW_US) -> DataFrame:
    """(path_key, at_us, op): the action each session of a path ends in, moves left out.

    What MERGE makes of a session needs no fold. A path that is created within it is as if nothing had been until it is removed again.
    Once an event other than a creation meets nothing, at the start or after such a removal, the path was there
    before, and from then on the last event alone decides: removed, or else modified. Otherwise the session ends in created, or in nothing.
    """
    b = bursts(_still(changes), window)
    there = F.max((F.col("op") != "created") & (F.col("before").isNull() | (F.col("before") == "removed"))).alias("_there")
    g = b.groupBy("path_key", "burst").agg(there, F.max(F.struct("at_us", "seq", "op")).alias("_last"))
    gone = F.col("_last.op") == "removed"
    op = F.when(F.col("_there"), F.when(gone, "removed").otherwise("modified")).when(~gone, "created")
    return g.select("path_key", F.col("_last.at_us").alias("at_us"), op.alias("op")).where("op IS NOT NULL")


def drop_directories(actions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, op, is_directory): a vanished or moved path is a directory when the catalog has children of it; one that is still there is no action."""
    from tidemark.functions.paths import ancestors

    parents = files.where("status <> 'deleted'").select(F.explode(ancestors(F.col("path_key"))).alias("path")).distinct().withColumn("_d", F.lit(True))
    key = F.when(F.col("op") == "move", F.col("old_path")).otherwise(F.col("path"))
    j = actions.withColumn("_k", key).join(parents.withColumnRenamed("path", "_k"), "_k", "left")
    is_dir = F.coalesce("_d", F.lit(False))
    return j.where(~(is_dir & F.col("op").isin("created", "modified"))).select("path", "op", is_dir.alias("is_directory"))
