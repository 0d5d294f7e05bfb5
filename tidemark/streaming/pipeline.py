"""The write path as a stream: mutations become state and index versions, one commit a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import changefeed, keyword
from tidemark.sources.warehouse import Warehouse


def commit_batch(house: Warehouse, batch: DataFrame, epoch: int, docs: DataFrame | None = None) -> bool:
    """Applies a micro-batch of mutations to the table ``mutations_applied`` and ``state``; False for an epoch committed before.

    Only the newest acceptable change of each file is kept, so the log stays as large as the state. With ``docs`` the index is
    brought along: old postings of files in the batch go, those of live ones come.
    """
    if house.manifest()["meta"].get("epoch", -1) >= epoch:
        return False
    last = batch.where(changefeed.acceptable()).groupBy("file_id").agg(F.max(F.struct("generation", "seq", "kind", "path", "mtime_ns", "status")).alias("m")).select("file_id", "m.*")
    if house.has("newest"):
        old = house.read("newest")
        last = old.unionByName(last).groupBy("file_id").agg(F.max(F.struct("generation", "seq", "kind", "path", "mtime_ns", "status")).alias("m")).select("file_id", "m.*")
    tables, meta = {"newest": last}, {"epoch": epoch}
    if docs is not None:
        touched = batch.select("file_id").distinct()
        live = last.where("kind = 'upsert'").join(touched, "file_id", "left_semi").select("file_id")
        fresh = keyword.index_rows(docs.join(live, "file_id", "left_semi"))
        tables["postings"] = keyword.laid_out(house.read("postings").join(touched, "file_id", "left_anti").select(*fresh.columns).unionByName(fresh) if house.has("postings") else fresh)
        indexed = docs.join(last.where("kind = 'upsert'").select("file_id"), "file_id", "left_semi")
        meta["keyword"] = {r["field"]: [r["docs"], r["terms"]] for r in keyword.field_stats(indexed).collect()}
    house.commit(tables, meta, by={"postings": ["bucket"]})
    return True


def run(mutations: DataFrame, house: Warehouse, checkpoint: str, docs: DataFrame | None = None):
    """Starts the stream; it ends when all that is available has been taken in."""
    return mutations.writeStream.foreachBatch(lambda df, epoch: commit_batch(house, df, epoch, docs)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
