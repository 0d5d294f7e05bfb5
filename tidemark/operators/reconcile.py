"""A scan of the disk against the catalog, roots, and the coverage of differences by queued work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import ancestors

TUPLE = ["size", "mtime_ns", "inode"]


def classify(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """(path_key, file_id, generation, outcome): each scanned path as added, modified or unchanged.

    Unchanged needs an equal (size, mtime_ns, inode), null equal to null, and a status of indexed or failed; a path of a
    deleted row that is there again is modified and keeps its file_id. A path listed several times counts once.
    """
    seen = snapshot.where("path_key IS NOT NULL").groupBy("path_key").agg(F.max(F.struct(*TUPLE)).alias("s"))
    known = files.select("path_key", "file_id", "generation", "status", F.struct(*TUPLE).alias("f"))
    j = seen.join(known, "path_key", "left")
    same = F.col("s.size").eqNullSafe(F.col("f.size")) & F.col("s.mtime_ns").eqNullSafe(F.col("f.mtime_ns")) & F.col("s.inode").eqNullSafe(F.col("f.inode"))
    outcome = F.when(F.col("file_id").isNull(), "added").when(same & F.col("status").isin("indexed", "failed"), "unchanged").otherwise("modified")
    return j.select("path_key", "file_id", "generation", outcome.alias("outcome"), F.col("s.size").alias("size"), F.col("s.mtime_ns").alias("mtime_ns"), F.col("s.inode").alias("inode"))


def removed(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the catalog, not deleted, that the scan does not list."""
    return files.where("status <> 'deleted'").join(snapshot.select("path_key").distinct(), "path_key", "left_anti")


def identities(files: DataFrame) -> DataFrame:
    """(size, mtime_ns, inode, n, file_id, old_path_key): live rows by identity; file_id and path only where there is just one."""
    live = files.where("status <> 'deleted' AND inode IS NOT NULL")
    g = live.groupBy(*TUPLE).agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"), F.min("path_key").alias("old_path_key"))
    return g.withColumns({"file_id": F.when(F.col("n") == 1, F.col("file_id")), "old_path_key": F.when(F.col("n") == 1, F.col("old_path_key"))})


def relocations(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """(path_key, old_path_key, file_id): scanned paths new to the catalog that carry exactly one live row's identity."""
    new = classify(snapshot, files).where("outcome = 'added' AND inode IS NOT NULL").select("path_key", *TUPLE)
    return new.join(identities(files).where("n = 1"), TUPLE).select("path_key", "old_path_key", "file_id")


def covered(differences: DataFrame, tasks: DataFrame) -> DataFrame:
    """Differences (path_key, generation, kind) that active work covers already.

    An active task on the path of at least the generation seen covers it; a removal is covered as well by a relocate whose old path it is.
    """
    active = tasks.where(F.col("state").isin("pending", "in_flight", "retry_wait", "waiting_dep"))
    by_path = active.groupBy("path_key").agg(F.max("generation").alias("_g"))
    moved = active.where("op = 'relocate' AND old_path_key IS NOT NULL").groupBy(F.col("old_path_key").alias("path_key")).agg(F.max("generation").alias("_m"))
    j = differences.join(by_path, "path_key", "left").join(moved, "path_key", "left")
    hit = (F.col("_g") >= F.col("generation")) | ((F.col("kind") == "remove") & (F.col("_m") >= F.col("generation")))
    return j.where(F.coalesce(hit, F.lit(False))).drop("_g", "_m")


def counts(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """(outcome, n) of a round."""
    gone = removed(snapshot, files).select(F.lit("removed").alias("outcome"))
    return classify(snapshot, files).select("outcome").unionByName(gone).groupBy("outcome").agg(F.count("*").alias("n"))


def overlaps(roots: DataFrame) -> DataFrame:
    """(root, outer): roots that lie within another one, by an equi join on ancestors. With a column ``recursive``, one whose rows all say false covers nothing below it."""
    deep = F.max(F.coalesce(F.col("recursive"), F.lit(True))) if "recursive" in roots.columns else F.max(F.lit(True))
    r = roots.groupBy("root").agg(deep.alias("_deep"))
    inner = r.select("root", F.explode(ancestors(F.col("root"))).alias("outer"))
    return inner.join(r.where("_deep").select(F.col("root").alias("outer")), "outer").select("root", "outer")


def collapse_nested(roots: DataFrame) -> DataFrame:
    """Queued roots without those that another covers."""
    return roots.select("root").distinct().join(overlaps(roots).select("root").distinct(), "root", "left_anti")


def trigger_priority(trigger: Column) -> Column:
    """Startup before dirty before periodic; unknown ones last."""
    return F.when(trigger == "startup", 3).when(trigger == "dirty", 2).when(trigger == "periodic", 1).otherwise(0)


def io_outcome(task_op: Column, on_disk: Column, same_tuple: Column, same_hash: Column, is_move: Column) -> Column:
    """What a worker does with a file: remove, unchanged, relocate, metadata_only or extract."""
    return F.when(task_op == "remove", "remove").when(~on_disk, "remove").when(is_move & same_hash, "relocate").when(same_tuple, "unchanged").when(same_hash, "metadata_only").otherwise("extract")


def settled(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path_key, outcome): paths of two looks at the disk as settled, unsettled (the tuple changed), too_large or gone."""
    a = first.groupBy("path_key").agg(F.max(F.struct(*TUPLE)).alias("a"))
    b = second.groupBy("path_key").agg(F.max(F.struct(*TUPLE)).alias("b"))
    j = a.join(b, "path_key", "left")
    outcome = F.when(F.col("b").isNull(), "gone").when(F.col("a.size") > 512 * 1024 * 1024, "too_large").when(F.col("a").eqNullSafe(F.col("b")), "settled").otherwise("unsettled")
    return j.select("path_key", outcome.alias("outcome"))
