"""Encoding of a corpus with a public byte-level BPE, and raw-byte decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import spread

#: Pattern that splits text before the merges (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the rank file lies, unless another is named.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts longer than this are encoded in parts of about this many characters.
PART_CHARS = 1 << 16
_LOADED: dict[str, tuple] = {}


def load(rank_file: str = RANKS) -> tuple:
    """(encoder, bytes by id) of a rank file; loaded once a worker."""
    if rank_file not in _LOADED:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            table[i] = piece
        _LOADED[rank_file] = (tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), table)
    return _LOADED[rank_file]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that encode as the whole does.

    A cut lies before white space that follows something else: no alternative of the pattern reaches over such a
    place, and none looks ahead from before it. Text without such a place stays in one part.
    """
    at = 0
    edge = re.compile(r"(?<=\S)\s")
    while len(text) - at > size:
        cut = edge.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, rank_file: str = RANKS) -> list[int]:
    """Ids of a text; none for an empty text or null."""
    if not text:
        return []
    encoder = load(rank_file)[0]
    return [i for p in parts(text) for i in encoder.encode_ordinary(p)]


def decode(ids: list[int], rank_file: str = RANKS) -> bytes:
    """The bytes that ids stand for, joined before any reading as UTF-8, since a character may spread over ids."""
    table = load(rank_file)[1]
    return b"".join([table[i] for i in ids])


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str = RANKS) -> DataFrame:
    """(key, ids ARRAY<INT>), one row for each row, without a shuffle.

    Null and empty texts get an empty list, a text of blanks is encoded like any other; special tokens are never made.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [encode(t, rank_file) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, "i4")
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), "i4", int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    source = spread(docs.select(key, text))
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", rank_file: str = RANKS) -> DataFrame:
    """(key, text): the texts that lists of ids stand for; null where the bytes are not valid UTF-8 or the list is null."""

    def read(x: list[int] | None) -> str | None:
        try:
            return None if x is None else decode(x, rank_file).decode("utf-8")
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(x) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    source = encoded.select(key, ids)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, text string")
