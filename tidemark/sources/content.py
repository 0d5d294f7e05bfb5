"""File contents: first bytes, sampled hashes, text decoding, float blobs."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes looked at, and of a sampled hash (fixed values).
SNIFF, WHOLE, SAMPLE = 8192, 128 * 1024, 16 * 1024
TEXT_LIMIT = 2 * 1024 * 1024


def sniff(content: Column) -> Column:
    return F.substring(content, 1, SNIFF)


def sample_hash(content: Column) -> Column:
    """Hash of a binary column: all of it up to 128 KiB, else head, middle, tail and the size. Edits between the samples go unseen, by design."""
    n = F.octet_length(content)
    mid = F.floor(n / 2).cast("int") - SAMPLE // 2 + 1
    parts = F.concat(F.substring(content, 1, SAMPLE), F.substr(content, mid, F.lit(SAMPLE)), F.substring(content, -SAMPLE, SAMPLE))
    return F.md5(F.concat(F.when(n <= WHOLE, content).otherwise(parts), F.lit("|"), n.cast("string")).cast("binary"))


def sample_hash_of(path: str) -> str:
    """The same hash of a file on disk, reading the samples only."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if size <= WHOLE:
            data = f.read()
        else:
            data = f.read(SAMPLE)
            f.seek(size // 2 - SAMPLE // 2)
            data += f.read(SAMPLE)
            f.seek(size - SAMPLE)
            data += f.read(SAMPLE)
    return hashlib.md5(data + f"|{size}".encode()).hexdigest()


def decode_text(data: bytes | None, bounded: bool = False) -> str | None:
    """Text of bytes: BOM off, UTF-8 if valid, else GB18030, else None. A bounded read may end in a cut character, of up to 3 bytes."""
    if data is None:
        return None
    data = data.removeprefix(b"\xef\xbb\xbf")
    for charset in ("utf-8", "gb18030"):
        for drop in range(4 if bounded else 1):
            try:
                return data[: len(data) - drop].decode(charset)
            except UnicodeDecodeError:
                continue
    return None


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode_text)


def truncate_utf8(text: str | None, limit: int = TEXT_LIMIT) -> tuple[str | None, bool]:
    """(text of at most ``limit`` bytes without a cut character, whether anything was cut)."""
    if text is None:
        return None, False
    data = text.encode("utf-8")
    return (text, False) if len(data) <= limit else (data[:limit].decode("utf-8", "ignore"), True)


def truncated(df: DataFrame, key: str, text: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """(key, text, truncated)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [truncate_utf8(t, limit) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in cut], pa.string()), pa.array([c for _, c in cut])], [key, "text", "truncated"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, text string, truncated boolean")


def floats_to_blob(v: list[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def blob_to_floats(b: bytes) -> list[float]:
    if len(b) % 4:
        raise ValueError("length is not a multiple of 4")
    return np.frombuffer(b, "<f4").tolist()
