"""Gauges, counters, histograms and the health of a node, computed from its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Histogram bounds in seconds (fixed values): the usual ones, and doubling ones from 10 ms.
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
DOUBLING_BOUNDS = [0.01 * 2**k for k in range(12)]


def backlog(tasks: DataFrame) -> DataFrame:
    """(state, n, oldest_created_at)."""
    return tasks.groupBy("state").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest_created_at"))


def oldest_pending(tasks: DataFrame, now_ms: int) -> DataFrame:
    """One row: age of the oldest pending task in ms, 0 without any."""
    return tasks.where("state = 'pending'").agg(F.coalesce(F.greatest(F.lit(now_ms) - F.min("created_at"), F.lit(0)), F.lit(0)).alias("age_ms"))


def histogram(values: DataFrame, value: str, by: list[str], bounds: list[float]) -> DataFrame:
    """(by, bound, n): cumulative counts; the last bound is infinite. One aggregation, then one row a bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = values.groupBy(*by).agg(*counts, F.count(value).alias("b_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("bound"), F.col("b_all").alias("n")))
    return g.select(*by, F.explode(rows).alias("h")).select(*by, "h.bound", "h.n")


def health(roots: DataFrame) -> DataFrame:
    """One row: roots by state, and the status: degraded before warming (pending roots) before degraded (dirty ones) before ready.

    roots: state (pending, active, degraded, stopped), dirty.
    """
    n = {s: F.count_if(F.col("state") == s).alias(s) for s in ("pending", "active", "degraded", "stopped")}
    g = roots.agg(*n.values(), F.count_if(F.col("dirty")).alias("dirty"))
    status = F.when(F.col("degraded") > 0, "degraded").when(F.col("pending") > 0, "warming").when(F.col("dirty") > 0, "degraded_dirty").otherwise("ready")
    return g.withColumn("status", status)


def acknowledge(roots: DataFrame, scans: DataFrame) -> DataFrame:
    """(root, cleared): a scan clears a root only at the epoch and dirty generation it began with."""
    j = scans.join(roots.select("root", F.col("epoch").alias("_e"), F.col("dirty_generation").alias("_d")), "root", "left")
    return j.select("root", F.coalesce((F.col("epoch") == F.col("_e")) & (F.col("dirty_generation") == F.col("_d")), F.lit(False)).alias("cleared"))
