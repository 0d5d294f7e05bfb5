"""Applying a stream of inserts, updates and deletes: column-wise last writer wins, in SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame


def acceptable(kind: str = "kind", path: str = "path") -> str:
    """SQL condition of mutations that may be applied."""
    return f"file_id >= 1 AND generation >= 1 AND (({kind} = 'upsert' AND {path} IS NOT NULL AND {path} <> '') OR ({kind} = 'delete' AND {path} IS NULL))"


def apply_feed(feed: DataFrame, fields: tuple[str, ...] = ("path", "mtime_ns", "status")) -> DataFrame:
    """The state a feed of mutations leaves: one row for each file whose newest change is an upsert.

    Order is (generation, seq), whatever order rows arrive in. An upsert whose generation is above all earlier
    ones, and a delete, replace the row; an upsert that repeats the generation changes only the fields it sets (not
    null). So each field is the value of the newest change that set it at the last generation and after the last
    delete; null if none did. Refused: null or non-positive file_id or generation, another kind, an upsert without a
    path, a delete with one. Repeated rows change nothing; two rows of one (generation, seq) that differ count as set
    by the largest value. An empty feed gives an empty table.

    One hash aggregation with map-side combine: a hot file sends one row a map task.
    """
    ver = "struct(generation, seq)"
    inner = ",\n".join(f"max(CASE WHEN kind = 'upsert' AND `{c}` IS NOT NULL THEN struct(generation, seq, `{c}` AS v) END) AS set_{c}" for c in fields)
    outer = ",\n".join(f"CASE WHEN set_{c}.generation = top.generation AND (gone IS NULL OR struct(set_{c}.generation, set_{c}.seq) > gone) THEN set_{c}.v END AS `{c}`" for c in fields)
    return feed.sparkSession.sql(
        f"""
        WITH folded AS (
            SELECT file_id, max({ver}) AS top, max(CASE WHEN kind = 'delete' THEN {ver} END) AS gone, {inner}
            FROM {{feed}} WHERE {acceptable()} GROUP BY file_id)
        SELECT file_id, top.generation AS generation, top.seq AS seq, {outer}
        FROM folded WHERE gone IS NULL OR top > gone""",
        feed=feed,
    )
