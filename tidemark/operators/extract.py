"""Extractors: a registry run over rows in Arrow batches; what an extractor raises becomes an error row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.functions.text import TEXT_EXTENSIONS, TEXT_NAMES
from tidemark.sources.content import TEXT_LIMIT, decode_text, truncate_utf8

SCHEMA = "file_id bigint, kind string, content string, truncated boolean, extractor_version string, error string, error_class string"


@dataclass(frozen=True)
class Extractor:
    name: str
    version: str
    matches: Callable[[str, bytes], bool]
    extract: Callable[[bytes], str]


def is_binary(head: bytes) -> bool:
    """A NUL, or more than a tenth control characters other than tab, LF, CR, FF and BS; a BOM is skipped."""
    head = head.removeprefix(b"\xef\xbb\xbf")
    control = sum(b < 32 and b not in (8, 9, 10, 12, 13) for b in head)
    return 0 in head or (len(head) > 0 and control * 10 > len(head))


def _is_text(path: str, head: bytes) -> bool:
    name = path.rsplit("/", 1)[-1].lower()
    ext = "." + name.rsplit(".", 1)[1] if "." in name else ""
    return not is_binary(head) and (name in TEXT_NAMES or ext in TEXT_EXTENSIONS)


def _plain(data: bytes) -> str:
    text = decode_text(data[: TEXT_LIMIT + 4], bounded=len(data) > TEXT_LIMIT + 4)
    if text is None:
        raise ValueError("neither UTF-8 nor GB18030")
    return text


PLAIN = Extractor("plain", "plain-3", _is_text, _plain)


def extract(files: DataFrame, registry: tuple[Extractor, ...] = (PLAIN,), fallback: Extractor | None = PLAIN, limit: int = TEXT_LIMIT) -> DataFrame:
    """(file_id, kind, content, truncated, extractor_version, error, error_class) of files (file_id, path, content).

    The first extractor that matches a path and its first bytes takes the file, else the fallback unless the bytes are binary.
    Null contents give an error row, and so does anything an extractor raises; no row is lost.
    """

    def one(path: str | None, data: bytes | None) -> tuple:
        if data is None or path is None:
            return "other", None, False, None, "no content", "permanent"
        head = data[:8192]
        found = next((e for e in registry if e.matches(path, head)), None) or (fallback if fallback and not is_binary(head) else None)
        if found is None:
            return "other", "", False, None, None, None
        try:
            text, cut = truncate_utf8(found.extract(data), limit)
            return "text", text, cut or len(data) > limit, found.version, None, None
        except Exception as e:  # noqa: BLE001 - an extractor may raise anything, and the file must not be lost
            return "text", None, False, found.version, f"{type(e).__name__}: {e}", "transient" if isinstance(e, (OSError, UnicodeError, ValueError)) else "permanent"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["file_id", "kind", "content", "truncated", "extractor_version", "error", "error_class"])

    return files.select("file_id", "path", "content").mapInArrow(run, SCHEMA)


def embed(frames: DataFrame, transport: Callable[[list[bytes]], tuple[str, list[list[float]]]], size: int = 32) -> DataFrame:
    """(file_id, frame_idx, model_version, vector, error): frames sent in batches; an answer of another length than its request is invalid.

    ``transport`` takes contents and gives the model and one vector each, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                n = part.num_rows
                try:
                    model, vectors = transport(part.column(2).to_pylist())
                    if len(vectors) != n or not model or len({len(x) for x in vectors}) > 1:
                        raise ValueError("invalid response")
                    out = [[model] * n, vectors, [None] * n]
                except Exception as e:  # noqa: BLE001 - a transport may raise anything
                    out = [[None] * n, [None] * n, [f"{type(e).__name__}: {e}"] * n]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.float32())), pa.array(out[2], pa.string())], ["file_id", "frame_idx", "model_version", "vector", "error"])

    return frames.select("file_id", "frame_idx", "content").mapInArrow(run, "file_id bigint, frame_idx int, model_version string, vector array<float>, error string")
