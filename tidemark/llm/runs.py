"""Repeated consecutive events: each run of like events on an entity becomes one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import clean_path
from tidemark.session import spread

#: White space and separators of Unicode (fixed values).
_BLANKS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def canonical_changes(changes: DataFrame) -> DataFrame:
    """(path_key, op, old_key, at_us, seq): op without outer blanks and case, both paths cleaned; no events without at_ts, path or seq."""
    op = F.lower(F.btrim(F.col("op"), F.lit(_BLANKS)))
    return spread(changes.select("op", "path", "old_path", "at_ts", "seq")).where("at_ts IS NOT NULL AND path IS NOT NULL AND seq IS NOT NULL").select(clean_path("path").alias("path_key"), op.alias("op"), clean_path("old_path").alias("old_key"), F.unix_micros(F.col("at_ts").cast("timestamp")).alias("at_us"), "seq")


def collapse_runs(events: DataFrame, entity: str = "path_key", value: list[str] | None = None, at: str = "at_us", seq: str = "seq", gap_us: int = 2_000_000, slice_us: int = 600_000_000) -> DataFrame:
    """One row a run: entity, value columns, min_seq, max_seq, n (events), first_us, last_us, duration_us.

    Events of an entity are ordered by ``at``, then ``seq``. An event continues the run of the one before it
    when all value columns are equal (null equals null) and it comes at most ``gap_us`` later. Each seq counts
    once, so repeated rows change nothing. Rows with a null entity, at or seq are left out; an empty table
    gives an empty one; extra columns are dropped.

    Within a slice of ``slice_us`` of an entity, the row number within (value, stretch without a gap) is
    subtracted from the row number within the slice: the difference is constant exactly along a run. A run that
    reaches over a slice's edge is joined up afterwards from one row a run, among the first and last runs
    of neighbouring slices only. So an entity that holds a third of all rows is spread over as many tasks as
    it has slices, and a run may still be of any length. ``slice_us`` must be at least ``gap_us``.
    """
    if slice_us < gap_us:
        raise ValueError("slice_us is below gap_us")
    value = value or ["op", "old_key"]
    e = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull() & F.col(seq).isNotNull()).select(F.col(entity).alias("_e"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(value)], F.col(at).alias("_at"), F.col(seq).alias("_seq"))
    vs = [f"_v{i}" for i in range(len(value))]
    e = e.withColumn("_slice", F.floor(F.col("_at") / F.lit(slice_us))).repartition("_e", "_slice")
    inside = Window.partitionBy("_e", "_slice").orderBy("_at", "_seq")
    e = e.withColumn("_again", F.lag("_seq").over(inside).eqNullSafe(F.col("_seq"))).where(~F.col("_again"))
    e = e.withColumn("_gap", F.coalesce((F.col("_at") - F.lag("_at").over(inside) > gap_us).cast("long"), F.lit(0)))
    e = e.withColumns({"_rn": F.row_number().over(inside), "_part": F.sum("_gap").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    alike = Window.partitionBy("_e", "_slice", "_part", *vs).orderBy("_at", "_seq")
    e = e.withColumn("_diff", F.col("_rn") - F.row_number().over(alike))
    runs = e.groupBy("_e", "_slice", "_part", *vs, "_diff").agg(F.min("_rn").alias("_pos"), F.min("_seq").alias("_lo"), F.max("_seq").alias("_hi"), F.count("*").alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    # only the runs at a slice's edges can go on in a neighbour; the others are finished
    edges = Window.partitionBy("_e", "_slice")
    runs = runs.withColumns({"_first": F.col("_pos") == F.min("_pos").over(edges), "_last": F.col("_pos") == F.max("_pos").over(edges)})
    near = F.col("_first") & (F.col("_from") - F.col("_slice") * slice_us <= gap_us) | F.col("_last") & ((F.col("_slice") + 1) * slice_us - F.col("_to") <= gap_us)
    runs = runs.withColumn("_open", near)
    order = Window.partitionBy("_e").orderBy("_slice", "_pos")
    met = [F.lag(v).over(order).eqNullSafe(F.col(v)) for v in vs]
    goes_on = (F.lag("_slice").over(order) == F.col("_slice") - 1) & F.col("_first") & F.lag("_last").over(order) & (F.col("_from") - F.lag("_to").over(order) <= gap_us)
    for m in met:
        goes_on = goes_on & m
    opened = runs.where("_open").withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = opened.groupBy("_e", "_run", *vs).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("_n"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    cols = ["_e", *vs, "_lo", "_hi", "_n", "_from", "_to"]
    every = runs.where("NOT _open").select(*cols).unionByName(joined.select(*cols))
    return every.select(F.col("_e").alias(entity), *[F.col(f"_v{i}").alias(c) for i, c in enumerate(value)], F.col("_lo").alias("min_seq"), F.col("_hi").alias("max_seq"), F.col("_n").alias("n"), F.col("_from").alias("first_us"), F.col("_to").alias("last_us"), (F.col("_to") - F.col("_from")).alias("duration_us"))
