"""Dead letters, redrive, retention, model upgrades and back-fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import image_format

DAY_MS = 86_400_000


def redrive(dead: DataFrame, files: DataFrame, priority: int = 1, ids: list[int] | None = None, error_class: str | None = None) -> DataFrame:
    """(file_id, path, generation, priority, outcome) for dead letters chosen by ids or by class, not both.

    superseded when the catalog is at a newer generation, missing without a row, else enqueued at the catalog's generation.
    """
    if (ids is None) == (error_class is None):
        raise ValueError("either ids or a class")
    chosen = dead.where(F.col("file_id").isin(ids) if ids is not None else F.col("error_class") == error_class)
    j = chosen.join(files.select("file_id", F.col("generation").alias("_g")), "file_id", "left")
    outcome = F.when(F.col("_g").isNull(), "missing").when(F.col("_g") > F.col("generation"), "superseded").otherwise("enqueued")
    return j.select("file_id", "path", F.coalesce("_g", "generation").alias("generation"), F.lit(priority).alias("priority"), outcome.alias("outcome"))


def version_mismatch(dead: DataFrame, extractor: str | None, model: str | None) -> DataFrame:
    """Dead letters that recorded another version than the current one. An empty current version turns its rule off; a null record is no mismatch."""
    rule = F.lit(False)
    if extractor:
        rule = rule | F.coalesce(F.col("extractor_version") != extractor, F.lit(False))
    if model:
        rule = rule | F.coalesce(F.col("embed_model_version") != model, F.lit(False))
    return dead.where(rule)


def expired(dead: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    return dead.where(F.col("updated_at") < now_ms - days * DAY_MS)


def forget(dead: DataFrame, gone: DataFrame) -> DataFrame:
    """Dead letters without those deleted; one that changed meanwhile (generation or updated_at) stays."""
    return dead.join(gone.select("file_id", "generation", "updated_at").distinct(), ["file_id", "generation", "updated_at"], "left_anti")


def failed_projection(dead: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, path, generation, content, source): minimal documents of failed files.

    The path is the dead letter's when generations match, else the catalog's; content is blank.
    """
    f = files.where("status = 'failed'").select("file_id", F.col("path_key").alias("_p"), F.col("generation").alias("_g"))
    j = f.join(dead.select("file_id", "path", "generation"), "file_id", "left")
    own = F.coalesce(F.col("_g") == F.col("generation"), F.lit(False))
    return j.select("file_id", F.when(own, F.col("path")).otherwise(F.col("_p")).alias("path"), F.col("_g").alias("generation"), F.lit("").alias("content"), F.when(own, "dead_letter").otherwise("catalog").alias("source"))


def model_upgrade_batch(files: DataFrame, model: str, limit: int = 256, after: int = 0) -> DataFrame:
    """(file_id, path_key, generation, has_more): the next indexed images of another model, by file_id.

    Generation goes one on and the status stays indexed; one row more than the limit is looked at, to tell whether there is more.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("limit is 1 to 10000")
    other = (F.col("status") == "indexed") & (F.col("kind") == "image") & ~F.col("embed_model_version").eqNullSafe(F.lit(model)) & (F.col("file_id") > after)
    cut = files.where(other).orderBy("file_id").limit(limit + 1)
    return cut.orderBy("file_id").limit(limit).select("file_id", "path_key", (F.col("generation") + 1).alias("generation"), F.lit(cut.count() > limit).alias("has_more"))


def media_backfill(files: DataFrame, head_hex: str = "head_hex") -> DataFrame:
    """(file_id, path_key, generation, format): indexed files of kind other whose first bytes are an image's, one generation on."""
    return files.where("kind = 'other' AND status = 'indexed'").withColumn("format", image_format(F.col(head_hex))).where("format IS NOT NULL").select("file_id", "path_key", (F.col("generation") + 1).alias("generation"), "format")
