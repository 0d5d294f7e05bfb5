"""The audit log: an outbox drained into JSON lines, at least once, in order of id; and redaction of what is logged."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values are paths (fixed values).
PATH_KEYS = {"path", "old_path", "root", "target", "directory"}


def outbox_rows(rows: DataFrame, action: str, source: str, details: dict[str, Column]) -> DataFrame:
    """Outbox rows (action, source, file_id, generation, target, details_json) for rows with file_id, generation and path."""
    return rows.select(F.lit(action).alias("action"), F.lit(source).alias("source"), "file_id", "generation", F.col("path").alias("target"), F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])).alias("details_json"))


def drain(outbox: DataFrame, file: str, batch: int = 1000) -> int:
    """Appends the outbox to a JSON-lines file and gives how many rows came new; ids there already are left out, so a retry repeats nothing.

    Rows come to the driver a batch at a time, in order of id, since a log has one order.
    """
    last = 0
    if os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            for line in f:
                last = max(last, json.loads(line)["id"]) if line.strip() else last
    done = 0
    with open(file, "a", encoding="utf-8") as f:
        while True:
            rows = outbox.where(F.col("id") > last).orderBy("id").limit(batch).collect()
            for r in rows:
                f.write(json.dumps(r.asDict(), ensure_ascii=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
            done += len(rows)
            if len(rows) < batch:
                return done
            last = rows[-1]["id"]


def acknowledge(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    """The outbox without the rows that were appended; unknown ids are no error."""
    return outbox.join(ids.select("id"), "id", "left_anti")


def hashed_path(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    ext = re.search(r"^.+(\.[^.]*)$", base)
    return "sha256:" + hashlib.sha256(path.encode()).hexdigest() + (ext[1] if ext and len(ext[1]) <= 16 else "")


def redact(value, key: str = ""):
    """A value fit for the log: paths hashed, text with a slash hashed whole, errors and unknown objects by their type."""
    if isinstance(value, dict):
        return {k: redact(v, k) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact(v, key) for v in value]
    if isinstance(value, str):
        if key in PATH_KEYS:
            return hashed_path(value)
        return "sha256:" + hashlib.sha256(value.encode()).hexdigest() if "/" in value or "\\" in value else value
    if value is None or isinstance(value, (bool, int, float)):
        return value
    return type(value).__name__
