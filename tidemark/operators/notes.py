"""Anchored notes with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(notes: DataFrame, now_ms: int) -> DataFrame:
    return notes.where(F.col("expire_at").isNull() | (F.col("expire_at") > now_ms))


def timeline(notes: DataFrame, now_ms: int, file_id: int | None = None) -> DataFrame:
    """Live notes at timestamps, of one file or all, in order of time, then id."""
    n = live(notes, now_ms).where("anchor_type = 'timestamp'")
    return (n if file_id is None else n.where(F.col("file_id") == file_id)).orderBy("file_id", "anchor_ts_ms", "note_id")


def expired(notes: DataFrame, now_ms: int, limit: int = 1000) -> DataFrame:
    """The oldest expired notes, as a reaper takes them."""
    return notes.where(F.col("expire_at") <= now_ms).orderBy("expire_at", "note_id").limit(limit)


def without(notes: DataFrame, gone: DataFrame) -> DataFrame:
    return notes.join(gone.select("note_id"), "note_id", "left_anti")


def invalid() -> Column:
    """Why a note's anchor is wrong, or null: a file anchor has neither line nor time, a line anchor a line from 1 on only, a timestamp anchor a time from 0 on only."""
    t, line, ts = F.col("anchor_type"), F.col("anchor_line"), F.col("anchor_ts_ms")
    good = ((t == "file") & line.isNull() & ts.isNull()) | ((t == "line") & (line >= 1) & ts.isNull()) | ((t == "timestamp") & (ts >= 0) & line.isNull())
    return F.when(F.col("content").isNull() | (F.col("content") == ""), "content").when(~F.coalesce(good, F.lit(False)), "anchor")


def create(notes: DataFrame, new: DataFrame) -> DataFrame:
    """The notes with new ones (all columns but ``note_id``), numbered on from the largest id in the order of file and content; invalid ones are left out."""
    from tidemark.operators.catalog import _numbered

    good = new.where(invalid().isNull())
    order = F.concat_ws("\x00", F.lpad(F.col("file_id").cast("string"), 20, "0"), F.col("content"), F.to_json(F.struct(*[c for c in new.columns])))
    last = notes.agg(F.coalesce(F.max("note_id"), F.lit(0))).first()[0]
    return notes.unionByName(_numbered(good.withColumn("_o", order), "_o", last, "note_id").select(*notes.columns))


def update(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """The notes with content and time to live of changes (note_id, content, expire_at); blank content and unknown ids change nothing. Of several the largest counts."""
    best = changes.where("content <> ''").groupBy("note_id").agg(F.max(F.struct("content", "expire_at")).alias("_n"))
    j = notes.join(best, "note_id", "left")
    hit = F.col("_n").isNotNull()
    return j.withColumns({"content": F.when(hit, F.col("_n.content")).otherwise(F.col("content")), "expire_at": F.when(hit, F.col("_n.expire_at")).otherwise(F.col("expire_at"))}).select(*notes.columns)
