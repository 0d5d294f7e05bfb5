"""Versioned tables under one manifest: writes of several tables become visible at once, readers keep a snapshot."""

from __future__ import annotations

import fcntl
import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folder import Folder


class Warehouse:
    """A folder all executors share. Each table lies in ``<table>/v=<n>-<id>``; the newest file of ``manifests`` names the versions that count.

    A manifest is created once and never replaced, so of two commits that start from one version the second fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)
        self.folder.make()

    def manifest(self) -> dict:
        """The current manifest; a damaged one is an error."""
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        if not names:
            return {"version": 0, "tables": {}, "meta": {}, "seals": {}}
        m = json.loads(self.folder.read(f"manifests/{names[-1]}"))
        body = {k: v for k, v in m.items() if k != "sha256"}
        if m.get("sha256") != _digest(body):
            raise ValueError("manifest is damaged")
        return body

    @contextmanager
    def owner(self, broken_after_s: float = 3600) -> Iterator[None]:
        """The lock of the only writer; a second one fails at once.

        On a local disk the lock ends with its process. Elsewhere it is a file, which after ``broken_after_s`` counts as left behind.
        """
        if self.folder.path.startswith("file:"):
            with open(self.folder.path.removeprefix("file:").replace("//", "/") + "/.lock", "w") as f:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except BlockingIOError:
                    raise RuntimeError("another owner holds the warehouse") from None
                yield
            return
        held = self.folder.read("owner.lock")
        if held is not None and float(held) + broken_after_s < time.time():
            self.folder.delete("owner.lock")
        if not self.folder.create("owner.lock", str(time.time())):
            raise RuntimeError("another owner holds the warehouse")
        try:
            yield
        finally:
            self.folder.delete("owner.lock")

    def read(self, table: str, at: dict | None = None) -> DataFrame:
        """A table as of a manifest, the current one by default."""
        return self.spark.read.parquet(self.folder.under((at or self.manifest())["tables"][table]))

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None, sealed: tuple[str, ...] = (), by: dict[str, list[str]] | None = None) -> dict:
        """Writes the tables as one new version. A commit that dies leaves files that no manifest names.

        ``sealed`` tables get a checksum of their rows, see ``intact``. ``by`` names the columns a table is partitioned by.
        """
        m = self.manifest()
        version = m["version"] + 1
        named, seals = dict(m["tables"]), dict(m.get("seals", {}))
        for name, df in tables.items():
            named[name] = f"{name}/v={version}-{uuid.uuid4().hex[:8]}"
            df.write.partitionBy(*(by or {}).get(name, [])).parquet(self.folder.under(named[name]))
            seals.pop(name, None)
            if name in sealed:
                seals[name] = _seal(self.spark.read.parquet(self.folder.under(named[name])))
        body = {"version": version, "tables": named, "meta": m["meta"] | (meta or {}), "seals": seals}
        if not self.folder.create(f"manifests/{version:020d}.json", json.dumps(body | {"sha256": _digest(body)})):
            raise RuntimeError("another commit came first")
        return body

    def intact(self, table: str, at: dict | None = None) -> bool:
        """Whether a sealed table's rows are those that were committed; False for one without a seal or that can't be read."""
        m = at or self.manifest()
        seal = m.get("seals", {}).get(table)
        try:
            return seal is not None and _seal(self.read(table, m)) == seal
        except Exception:  # files gone or damaged
            return False

    def valid_snapshot(self, model: str, dims: int, durable_revision: int, table: str | None = None) -> bool:
        """Whether the vector snapshot of the manifest can be loaded: format, model, dims, a revision that the log has and, where a table is named, its rows."""
        m = self.manifest()
        meta = m["meta"].get("vectors", {})
        fits = meta.get("format") == 1 and meta.get("model") == model and meta.get("dims") == dims and 0 <= meta.get("revision", -1) <= durable_revision
        return fits and (table is None or self.intact(table, m))


def _seal(df: DataFrame) -> list[int]:
    """Count and checksums of a table's rows, in any order; null flags are hashed too, since the hash skips nulls."""
    cells = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])] if df.columns else [F.lit(0)]
    n, total, low = df.select(cells[0].alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))).first()
    return [n, total or 0, low or 0]


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
