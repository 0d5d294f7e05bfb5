"""Work on whole directories: expansion, removal fences and conflicts of scopes. Prefix joins are equi joins on ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import ancestors, relative_to


def descendants(parents: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, path_key, file_id, generation): catalog rows strictly below each directory, deleted ones left out."""
    below = files.where("status <> 'deleted'").select("path_key", "file_id", "generation", F.explode(ancestors(F.col("path_key"))).alias("directory"))
    return below.join(parents.select("directory").distinct(), "directory", "left_semi")


def expand_remove(parents: DataFrame, files: DataFrame) -> DataFrame:
    """(path_key, file_id, generation, priority, op): a removal of each descendant, one generation on.

    parents: directory, priority. Of nested parents the most urgent priority holds.
    """
    hit = descendants(parents, files).join(parents.groupBy("directory").agg(F.min("priority").alias("priority")), "directory")
    return hit.groupBy("path_key", "file_id", "generation").agg(F.min("priority").alias("priority")).select("path_key", "file_id", (F.col("generation") + 1).alias("generation"), "priority", F.lit("remove").alias("op"))


def expand_relocate(moves: DataFrame, files: DataFrame) -> DataFrame:
    """(old_path_key, path_key, file_id, generation): descendants under the destination with the same relative path. moves: directory, destination."""
    hit = descendants(moves, files).join(moves, "directory")
    return hit.select(F.col("path_key").alias("old_path_key"), F.concat_ws("/", "destination", relative_to(F.col("path_key"), F.col("directory"))).alias("path_key"), "file_id", (F.col("generation") + 1).alias("generation"))


def scope_conflicts(tasks: DataFrame, scopes: DataFrame) -> DataFrame:
    """(task_id, scope): tasks whose path is a scope's or lies within a directory scope, or whose directory holds a scope's path.

    tasks: task_id, path, is_dir; scopes: scope, is_dir. Equality and containment in either direction are equi joins.
    """
    t = tasks.select("task_id", "path", "is_dir")
    s = scopes.select("scope", F.col("is_dir").alias("scope_dir")).distinct()
    same = t.join(s, F.col("path") == F.col("scope")).select("task_id", "scope")
    inside = t.select("task_id", F.explode(ancestors(F.col("path"))).alias("_a")).join(s.where("scope_dir"), F.col("_a") == F.col("scope")).select("task_id", "scope")
    around = s.select("scope", F.explode(ancestors(F.col("scope"))).alias("_a")).join(t.where("is_dir"), F.col("_a") == F.col("path")).select("task_id", "scope")
    return same.unionByName(inside).unionByName(around).distinct()


def removal_fence(prefixes: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(path_key, generation, source): all that a removed root leaves to remove.

    Catalog rows below it go one generation on; paths queued or in flight but not in the catalog get one more than their
    largest generation; parked work is superseded.
    """
    p = prefixes.select(F.col("root").alias("directory")).distinct()
    rows = descendants(p, files).groupBy("path_key").agg((F.max("generation") + 1).alias("generation")).withColumn("source", F.lit("catalog"))
    below = tasks.select("path_key", "state", "generation", F.explode(ancestors(F.col("path_key"))).alias("directory")).join(p, "directory", "left_semi").drop("directory").distinct()
    early = below.where("state IN ('pending', 'in_flight')").join(files.select("path_key"), "path_key", "left_anti").groupBy("path_key").agg((F.max("generation") + 1).alias("generation")).withColumn("source", F.lit("queued"))
    parked = below.where("state IN ('retry_wait', 'waiting_dep')").groupBy("path_key").agg(F.max("generation").alias("generation")).withColumn("source", F.lit("superseded"))
    return rows.unionByName(early).unionByName(parked)


def expansion_counts(expanded: DataFrame, tasks: DataFrame) -> DataFrame:
    """(matched, inserted, coalesced): rows of an expansion (path_key, generation); those whose path has an unfinished task join it."""
    active = tasks.where(F.col("state").isin("pending", "in_flight", "retry_wait", "waiting_dep")).select("path_key").distinct().withColumn("_a", F.lit(1))
    j = expanded.select("path_key").join(active, "path_key", "left")
    return j.agg(F.count("*").alias("matched"), F.count_if(F.col("_a").isNull()).alias("inserted"), F.count_if(F.col("_a").isNotNull()).alias("coalesced"))
