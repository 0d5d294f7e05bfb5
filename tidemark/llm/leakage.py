"""Evaluation texts leaking into training text: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Words a fingerprint covers and fingerprints a window covers: any shared run of GRAM + WINDOW - 1 words shares one.
GRAM, WINDOW = 3, 2
#: Characters of evaluation items that an index holds, which is what each task keeps in memory: some 100 MB. Only beyond them is there a further pass.
BLOCK_CHARS = 32_000_000
#: Scripts written without spaces, of which each character counts as a word (fixed values): Thai to Lao, Burmese, Khmer, kana, bopomofo, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_MARKS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Words of a text without case, accents, punctuation, invisible marks and spacing; of scripts without spaces, the characters."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())))
    return _WORD.findall(text.lower())


class _Codes(dict):
    """Stable 64-bit codes of words; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_CODES = _Codes()


def codes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_CODES.__getitem__, ws), "u8", len(ws))


def fingerprints(code: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the smallest gram hash of each window; of a text shorter than a window all grams."""
    n = len(code) - gram + 1
    if n <= 0:
        return np.empty(0, "i8"), np.empty(0, "u8")
    with np.errstate(over="ignore"):
        h = np.zeros(n, "u8")
        for k in range(gram):
            h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    if window <= 1 or n < window:
        return np.arange(n), h
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(n - window + 1) + view.argmin(axis=1))
    return at, h[at]


def longest_stretch(item: np.ndarray, doc: np.ndarray, i: int, j: int, least: int) -> int:
    """Length of the longest stretch of the item around the hit item[i] == doc[j] that the document holds.

    Words of the stretch may be replaced, added or left out, one in eight at most; 0 if none reaches ``least``.
    """
    n, m = len(item), len(doc)
    most = n // 8

    def reach(a: np.ndarray, b: np.ndarray) -> list[int]:
        """By number of edits, how many words of ``a`` are covered from its start."""
        best, front = [], {0: 0}  # diagonal (b - a) -> words of a
        for e in range(most + 1):
            for d in front:
                x = front[d]
                while x < len(a) and x + d < len(b) and a[x] == b[x + d]:
                    x += 1
                front[d] = x
            best.append(min(len(a), max(front.values())))
            nxt: dict[int, int] = {}
            for d, x in front.items():
                for dd, xx in ((d, x + 1), (d + 1, x), (d - 1, x + 1)):
                    if xx <= len(a) and 0 <= xx + dd <= len(b):
                        nxt[dd] = max(nxt.get(dd, -1), xx)
            front = nxt or front
        return best

    right = reach(item[i:], doc[j:])
    left = reach(item[:i][::-1], doc[max(0, j - 2 * n) : j][::-1])
    longest = 0
    for e1, r in enumerate(right):
        for e2, l in enumerate(left):
            length, e = r + l, e1 + e2
            spare = n - length
            while spare and 8 * (e + 1) <= length + 1 and e < most:  # a replaced word at an end belongs to the stretch
                length, e, spare = length + 1, e + 1, spare - 1
            if e <= most and length >= 8 * e:
                longest = max(longest, length)
    return longest if longest >= least else 0


@dataclass
class Index:
    """Fingerprints of a block of items, sorted by hash; the words of all items in a row, with RUN words that match nothing after each."""

    ids: list
    items: list[np.ndarray]
    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    run: np.ndarray
    specs: list[tuple[int, int]]
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    pos: list[np.ndarray]


def least_words(n: int) -> int:
    """Half of an item's words, rounded up."""
    return (n + 1) // 2


def spec_of(n: int) -> tuple[int, int]:
    """(gram, window) that meets every stretch that counts for an item of n words.

    From 7 words on, half an item with one edit in eight words holds at least 4 words in a row. Shorter items
    allow no edit, and all their grams of half the words are kept.
    """
    return (GRAM, WINDOW) if n >= 7 else (least_words(n), 1)


#: Equal words in a row at most that ``run_of`` asks for.
RUN = 7


def run_of(n: int) -> int:
    """Equal words in a row that every stretch that counts holds, for an item of n words.

    A stretch of L words with L // 8 edits falls into that many runs and one more, of which the longest has at least the mean length.
    """
    return min(RUN, min(-(-(x - x // 8) // (x // 8 + 1)) for x in range(least_words(n), min(n, 64) + 1))) if n <= 64 else 6 if n < 98 else RUN


def build_index(rows: list[tuple]) -> Index:
    ids, items = [], []
    for item_id, text in rows:
        c = codes(words(text))
        if len(c):
            ids.append(item_id)
            items.append(c)
    specs = sorted({spec_of(len(c)) for c in items})
    hashes, item, pos = [], [], []
    for spec in specs:
        hs, its, ps = [], [], []
        for k, c in enumerate(items):
            if spec_of(len(c)) == spec:
                p, h = fingerprints(c, *spec)
                hs.append(h), its.append(np.full(len(h), k)), ps.append(p)
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        hashes.append(h[order]), item.append(np.concatenate(its)[order]), pos.append(np.concatenate(ps)[order])
    start = np.cumsum([RUN, *(len(c) + RUN for c in items)])[: len(items)]
    flat = np.zeros(RUN + sum(len(c) + RUN for c in items), "u8")
    for at, c in zip(start, items, strict=True):
        flat[at : at + len(c)] = c
    return Index(ids, items, flat, start, np.array([len(c) for c in items], int), np.array([run_of(len(c)) for c in items], int), specs, hashes, item, pos)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of n from lo on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def hits(index: Index, doc: np.ndarray, spec: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in it, place in the document) of the fingerprints that both have and that can lie in a stretch that counts.

    Items of whose words the document lacks too many are left out first, then fingerprints in too few equal words. Both checks are
    steps over whole arrays, and the first one is over distinct fingerprints, so that a stock phrase of many items costs little.
    """
    gram = index.specs[spec][0]
    at, h = fingerprints(doc, *index.specs[spec])
    known = index.hashes[spec]
    found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    at, h = at[found], h[found]
    own, which = np.unique(h, return_inverse=True)
    lo = np.searchsorted(index.hashes[spec], own, "left")
    n = np.searchsorted(index.hashes[spec], own, "right") - lo
    if not n.any():
        return (np.zeros(0, int),) * 3
    r = _ranges(lo, n)
    asked, back = np.unique(index.item[spec][r], return_inverse=True)
    size = index.size[asked]
    words_of, known = index.flat[_ranges(index.start[asked], size)], np.unique(doc)
    there = known[np.minimum(np.searchsorted(known, words_of), len(known) - 1)] == words_of
    half = (size + 1) // 2
    ok = (np.add.reduceat(there, np.cumsum(size) - size, dtype=int) >= half - half // 8)[back]
    n = np.bincount(np.repeat(np.arange(len(own)), n)[ok], minlength=len(own))
    r = r[ok]
    first = np.cumsum(n) - n
    seen = n[which]
    r = r[_ranges(first[which], seen)]
    item, i, j = index.item[spec][r], index.pos[spec][r], np.repeat(at, seen)
    padded = np.concatenate([np.ones(RUN, "u8"), doc, np.ones(RUN, "u8")])  # 1 here and 0 there: no word's code in practice, and unequal
    a, b = index.start[item] + i, j + RUN
    run = np.zeros(len(r), int)
    going = np.ones(len(r), bool)
    for d in range(RUN):
        going = going & (index.flat[a + d] == padded[b + d])
        run += going
    full = run >= gram  # not only the hashes agree
    going = full.copy()
    for d in range(1, RUN):
        going = going & (index.flat[a - d] == padded[b - d])
        run += going
    ok = full & (run >= index.run[item])
    return item[ok], i[ok], j[ok]


def matches(index: Index, text: str | None) -> list[tuple[int, int]]:
    """(index of an item, longest stretch) for the items that a text holds."""
    doc = codes(words(text))
    best: dict[int, int] = {}
    for spec in range(len(index.specs)):
        run_end: dict[tuple[int, int], int] = {}  # by item and diagonal, where the run of equal words extended last ends
        for k, i, j in zip(*(x.tolist() for x in hits(index, doc, spec)), strict=True):
            if i < run_end.get((k, j - i), 0):  # from the same run of equal words the same stretches are reached
                continue
            words_of = index.items[k]
            if best.get(k) == len(words_of):
                continue
            right = doc[j : j + len(words_of) - i]
            unequal = np.flatnonzero(words_of[i : i + len(right)] != right)
            run_end[k, j - i] = i + (int(unequal[0]) if len(unequal) else len(right))
            found = longest_stretch(words_of, doc[: j + 2 * len(words_of)], i, j, least_words(len(words_of)))
            if found > best.get(k, 0):
                best[k] = found
    return list(best.items())


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_key, item_key, words, share): documents that hold a stretch of at least half of an item's words.

    Letter case, accents, punctuation, spacing and line breaks don't matter; one word in eight of the stretch may
    be replaced, added or left out. ``words`` is the longest such stretch, ``share`` its part of the item. Null and
    empty texts match nothing; repeated documents or items give one row; extra columns are not read.

    Documents are read once and never shuffled: the items' winnowed fingerprints are joined within each Arrow
    batch by binary search, then each hit is extended over the document's words. An index holds BLOCK_CHARS characters of
    items, a million sentences or so; further blocks are further passes, so memory has a bound.
    """
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    source = spread(docs.select(F.col(doc_key).alias("_d"), F.col(text).alias("_t")))
    kind = f"`{doc_key}` {docs.schema[doc_key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, words int, share double"
    found = None
    for block in range(blocks):
        part = items.select(item_key, text).where(F.col(text).isNotNull() & F.col(item_key).isNotNull() & (F.pmod(F.xxhash64(item_key), F.lit(blocks)) == block)).distinct()
        index = docs.sparkSession.sparkContext.broadcast(build_index(sorted(map(tuple, part.collect()))))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                out: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out += [(d, ix.ids[k], n, n / len(ix.items[k])) for k, n in matches(ix, t)]
                d, i, w, s = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, b.schema[0].type), pa.array(i, item_type), pa.array(w, pa.int32()), pa.array(s, pa.float64())], [doc_key, item_key, "words", "share"])

        item_type = pa.int64() if items.schema[item_key].dataType.simpleString() == "bigint" else pa.string()
        one = source.mapInArrow(run, kind)
        found = one if found is None else found.unionByName(one)
    return found.groupBy(doc_key, item_key).agg(F.max("words").alias("words"), F.max("share").alias("share"))
