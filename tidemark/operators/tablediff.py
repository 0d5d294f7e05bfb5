"""Differences between two copies of a dataset, found with invertible Bloom lookup tables.

Of each row only hashes of its key and of its fields travel. Keys fall into buckets; each bucket has a small table of cells, and
a distinct row adds the XOR of its hashes to three of them. Subtracting one side's tables from the other's cancels all
rows that both have, so what is left can be peeled: a cell that holds one row gives its key, whose other cells then hold one
less. Only the peeled keys are fetched from the two sources and compared field by field. A bucket that doesn't
peel is compared whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged

#: Cells a row is added to, each in its own third of the bucket's table.
HASHES = 3

# The published constants of xxHash's 64-bit variant (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for these BIGINT columns."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), 42, "u8")
        for c in columns:
            h = h + _P5 + np.uint64(8)
            h = h ^ (_rotl(c.view("u8") * _P2, 31) * _P1)
            h = _rotl(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view("i8")


def _peel(cells: pd.DataFrame, third: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Rows (key hashes, side) left in one bucket's subtracted table; whether all of it came out."""
    n = HASHES * third
    count = np.zeros(n, "i8")
    lanes = np.zeros((4, n), "i8")  # key hash, second key hash, row hash, check
    at = cells["cell"].to_numpy()
    count[at] = cells["n"]
    for lane, c in zip(lanes, ("k1", "k2", "rh", "ck"), strict=True):
        lane[at] = cells[c]
    found = []
    while True:
        one = np.flatnonzero(np.abs(count) == 1)
        one = one[hash_longs(lanes[0, one], lanes[1, one], lanes[2, one]) == lanes[3, one]]
        if not len(one):
            break
        rows = np.unique(np.vstack([lanes[:, one], count[one]]), axis=1)
        for k in range(HASHES):
            cell = k * third + np.mod(hash_longs(rows[0], np.full(rows.shape[1], k, "i8")), third)
            np.subtract.at(count, cell, rows[4])
            for lane, x in zip(lanes, rows[:4], strict=True):
                np.bitwise_xor.at(lane, cell, x)
        found += list(zip(rows[0].tolist(), rows[1].tolist(), rows[4].tolist(), strict=True))
        if len(found) > 4 * n:
            return found, False
    return found, not count.any() and not lanes.any()


def differing_keys(both: DataFrame, buckets: int, cells: int) -> DataFrame:
    """(k1, k2, bucket, whole): hashes of keys whose rows differ or lie on one side only.

    ``whole`` rows have null hashes and name a bucket whose table could not be peeled.
    ``both`` has ``side`` (1 or -1), ``k1``, ``k2``, ``rh``, each row once.
    """
    third = max(1, math.ceil(cells / HASHES))
    cell = F.explode(F.array(*[F.lit(k * third) + F.pmod(F.xxhash64("k1", F.lit(k).cast("long")), F.lit(third)) for k in range(HASHES)])).alias("cell")
    tables = (
        both.select(F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"), "side", "k1", "k2", "rh", F.xxhash64("k1", "k2", "rh").alias("ck"), cell)
        .groupBy("bucket", "cell")
        .agg(F.sum("side").alias("n"), *[F.bit_xor(c).alias(c) for c in ("k1", "k2", "rh", "ck")])
        .where("n <> 0 OR k1 <> 0 OR k2 <> 0 OR rh <> 0 OR ck <> 0")
    )

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        found, clean = _peel(pdf, third)
        b = int(pdf["bucket"].iloc[0])
        if not clean:
            return pd.DataFrame({"k1": [None], "k2": [None], "bucket": [b], "whole": [True]})
        keys = sorted({(a, c) for a, c, _ in found})
        return pd.DataFrame({"k1": [a for a, _ in keys], "k2": [c for _, c in keys], "bucket": b, "whole": False})

    return tables.groupBy("bucket").applyInPandas(peel, "k1 bigint, k2 bigint, bucket int, whole boolean")


def diff_tables(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_name: str = "left", right_name: str = "right", bucket_rows: int = 4096, diff_share: float = 0.2) -> DataFrame:
    """(key, field, left_value, right_value): keys on one side only and fields that differ, as text.

    ``field`` is ``only_in_<left_name>``, ``only_in_<right_name>`` or a field's name; null equals null and
    differs from any value. Rows with a null key are left out. Rows repeated within a side count once; of rows
    that share a key and differ the largest (by the fields in order) stands. Columns other than key and fields
    are dropped. Two empty tables give an empty result.

    bucket_rows: rows a bucket gets on average; diff_share: share of keys expected to differ,
    for which a bucket's table has room. Both set the cost only: a bucket with more differences than fit is
    compared whole.
    """
    # xxhash64 skips nulls, so that (null, 1) and (1, null) would meet: the null flags are hashed as well
    flags: list[Column] = [F.col(c).isNull() for c in fields]
    k1, k2 = F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")
    sources = [df.where(F.col(key).isNotNull()).select(key, *fields) for df in (left, right)]
    hashed = [df.select(F.lit(sign).cast("long").alias("side"), k1, k2, F.xxhash64(*fields, *flags).alias("rh")) for df, sign in zip(sources, (1, -1), strict=True)]
    both = staged(hashed[0].unionByName(hashed[1]).distinct(), "diff")
    rows = both.count()
    buckets = max(1, math.ceil(rows / 2 / bucket_rows))
    cells = max(24, math.ceil(3.2 * diff_share * min(bucket_rows, rows)))
    keys = staged(differing_keys(both, buckets, cells), "keys")
    peeled, whole = keys.where(~F.col("whole")).select("k1", "k2"), keys.where("whole").select("bucket")
    unpeeled = not whole.isEmpty()
    sides = []
    for df, side in zip(sources, ("l", "r"), strict=True):
        df = df.select(F.col(key).alias("_key"), F.struct(*fields).alias("_row"), k1, k2)
        some = df.join(peeled, ["k1", "k2"], "left_semi")
        if unpeeled:
            some = some.unionByName(df.withColumn("bucket", F.pmod("k1", F.lit(buckets)).cast("int")).join(whole, "bucket", "left_semi").drop("bucket"))
        sides.append(some.groupBy("_key").agg(F.max("_row").alias(side)))
    met = sides[0].join(sides[1], "_key", "full")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    none = F.lit(None).cast("string")
    differing = F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.struct(F.lit(c).alias("field"), text("l", c).alias("left_value"), text("r", c).alias("right_value"))) for c in fields]), lambda x: x.isNotNull())
    alone = lambda name: F.array(F.struct(F.lit(f"only_in_{name}").alias("field"), none.alias("left_value"), none.alias("right_value")))
    found = F.when(F.col("r").isNull(), alone(left_name)).when(F.col("l").isNull(), alone(right_name)).otherwise(differing)
    return met.select(F.col("_key").alias(key), F.explode(found).alias("_d")).select(key, "_d.field", "_d.left_value", "_d.right_value")
