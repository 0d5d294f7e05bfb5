"""Garbled text from wrong character encoding: found by a bigram classifier, restored by inverting the chain."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Chains (fixed values): the encoding of the bytes, the encoding they were read in, how many times over.
CHAINS = [
    ("utf-8", "cp1252", 1),
    ("utf-8", "latin-1", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    ("utf-8", "cp1250", 1),
    ("utf-8", "cp1251", 1),
    ("utf-8", "koi8-r", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "mac-roman", 1),
    ("utf-8", "gb18030", 1),
    ("utf-8", "shift_jis", 1),
    ("utf-8", "big5", 1),
    ("cp1251", "cp1252", 1),
    ("koi8-r", "cp1252", 1),
    ("koi8-r", "cp1251", 1),
    ("cp1251", "koi8-r", 1),
    ("cp866", "cp1251", 1),
    ("cp866", "cp1252", 1),
    ("cp1250", "cp1252", 1),
    ("iso8859-2", "cp1252", 1),
    ("cp1252", "cp1251", 1),
    ("cp1252", "cp1250", 1),
    ("cp1250", "cp1251", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "mac-roman", 1),
    ("mac-roman", "cp1252", 1),
    ("cp437", "cp1252", 1),
    ("cp850", "cp1252", 1),
    ("gb18030", "cp1252", 1),
    ("gb18030", "cp1251", 1),
    ("shift_jis", "cp1252", 1),
    ("euc-jp", "cp1252", 1),
    ("shift_jis", "gb18030", 1),
    ("cp1252", "gb18030", 1),
    # nothing of these comes back
    ("cp1252", "utf-8", 1),
    ("cp1251", "utf-8", 1),
    ("gb18030", "utf-8", 1),
    ("ascii", "ascii", 1),
    ("latin-1", "latin-1", 1),
]
#: What the classifier is trained on: rows at most, by a hash of their keys; lines of them at most, by a hash of the line, each in pieces of
#: so many characters; lines at most of the first rounds, which only tell sound lines from garbled ones.
TRAIN_ROWS, TRAIN_LINES, TRAIN_PIECE, FIRST_LINES = 4000, 20_000, 400, 4000
#: What a bigram that tells nothing takes from every chain.
DULL = -0.1
#: A bigram's log likelihood ratio lies within these bounds, so that one strange pair of bytes is no evidence alone.
LEAST, MOST = -4.0, 4.0
#: Score that a stretch must reach: where inverting it gives valid text, and where nothing can confirm it.
CONFIRMED, ALONE = 4.0, 9.0
#: A bigram is usual from this many a clean line on; how much less strange a stretch set right must be.
USUAL, MARGIN = 0.01, 2.5


@cache
def _decoding(charset: str) -> tuple[str, ...]:
    """Character of each byte; bytes the charset leaves open stand for the control character of their number."""
    return tuple(bytes([b]).decode(charset, "ignore") or chr(b) for b in range(256))


@cache
def _encoding(charset: str):
    return codecs.charmap_build("".join(_decoding(charset)))


_SINGLE = {"cp1252", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "iso8859-2", "latin-1"}


def to_bytes(text: str, charset: str, strict: bool = True) -> bytes | None:
    """Bytes that read as ``text`` in a charset; None if there are none."""
    try:
        if charset in _SINGLE:
            return codecs.charmap_encode(text, "strict" if strict else "replace", _encoding(charset))[0]
        return text.encode(charset, "strict" if strict else "replace")
    except UnicodeEncodeError:
        return None


def to_text(data: bytes, charset: str, strict: bool = True) -> str | None:
    try:
        if charset in _SINGLE:
            return codecs.charmap_decode(data, "strict", "".join(_decoding(charset)))[0]
        return data.decode(charset, "strict" if strict else "replace")
    except UnicodeDecodeError:
        return None


def garble(text: str, chain: tuple[str, str, int]) -> str:
    """What reading the bytes of ``text`` in the wrong encoding makes of it."""
    true, wrong, times = chain
    for _ in range(times):
        text = to_text(to_bytes(text, true, strict=False), wrong, strict=False)
    return text


def invert(text: str, chain: tuple[str, str, int]) -> str | None:
    """The original of a garbled text; None unless each step back is strictly decodable."""
    true, wrong, times = chain
    if wrong == true or wrong == "utf-8":
        return None
    for _ in range(times):
        data = to_bytes(text, wrong)
        text = None if data is None else to_text(data, true)
        if text is None:
            return None
    if true in _SINGLE and re.search(r"[\x80-\x9f]", text):
        return None
    return text


def bigrams(text: str) -> np.ndarray:
    """Hashed byte bigrams; with 16 bits the hash is exact."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1").astype("i4")
    return b[:-1] * 256 + b[1:]


@dataclass
class Model:
    """Log likelihood ratio of each bigram between each chain and clean text; how strange each is in clean text."""

    chains: list[tuple[str, str, int]]
    ratio: np.ndarray
    weight: np.ndarray
    margin: float

    def runs(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bigrams that tell something, some at a time: their places and, for each chain, the sum of ratios up to and before each.

        Every bigram between two of them takes DULL, so that nothing is lost by leaving them out.
        """
        grams = bigrams(text)
        at = np.flatnonzero(_TELLING[grams])
        total = np.zeros((len(self.chains), 1))
        last = -1
        for i in range(0, len(at), 8192):
            here = at[i : i + 8192]
            dull = DULL * (np.diff(here, prepend=last) - 1)
            ratio = self.ratio[:, grams[here]]
            sums = np.cumsum(ratio + dull, axis=1, dtype="f4") + total
            yield here, sums, sums - ratio
            total, last = sums[:, -1:], here[-1]

    def scan(self, text: str) -> list[tuple[float, int, int, int]]:
        """(score, chain, from, to), the likeliest first: for each chain the stretch of bytes with the highest sum of ratios."""
        n = len(self.chains)
        rows = np.arange(n)
        low, low_at = np.full(n, np.inf), np.zeros(n, int)
        best, start, stop = np.zeros(n), np.zeros(n, int), np.zeros(n, int)
        for here, sums, before in self.runs(text):
            lowest = np.minimum.accumulate(np.concatenate([low[:, None], before], axis=1), axis=1)[:, 1:]
            gain = sums - lowest
            ends = gain.argmax(axis=1)
            top = gain[rows, ends]
            for c in np.flatnonzero((top > best) & (top >= CONFIRMED)):
                best[c], stop[c] = top[c], here[ends[c]] + 2
                if lowest[c, ends[c]] < low[c]:
                    start[c] = here[np.flatnonzero(before[c, : ends[c] + 1] <= lowest[c, ends[c]])[-1]]
                else:
                    start[c] = low_at[c]
            least = before.argmin(axis=1)
            fell = before[rows, least] < low
            low[fell], low_at[fell] = before[rows, least][fell], here[least[fell]]
        return sorted(((float(best[c]), int(c), int(start[c]), int(stop[c])) for c in np.flatnonzero(best >= CONFIRMED)), key=lambda x: -x[0])

    def parts(self, text: str, size: int) -> list[str]:
        """The text in parts of about ``size`` bytes, cut only where no chain's stretch can go on: each would do better to start anew there."""
        cuts, low, last = [], np.full((len(self.chains), 1), np.inf), 0
        for here, sums, before in self.runs(text):
            lowest = np.minimum.accumulate(np.concatenate([low, before], axis=1), axis=1)
            free = here[1:][(before[:, 1:] <= lowest[:, 1:-1]).all(axis=0)]
            for at in free:
                if at - last >= size:
                    cuts.append(int(at))
                    last = at
            low = lowest[:, -1:]
        data = text.encode("utf-8", "surrogatepass")
        out, begin = [], 0
        for at in cuts:
            while at < len(data) and 128 <= data[at] < 192:  # not within a character
                at += 1
            out.append(data[begin:at].decode("utf-8", "surrogatepass"))
            begin = at
        return [*out, data[begin:].decode("utf-8", "surrogatepass")]

    def worst(self, text: str) -> float:
        return max([0.0, *(x[0] for x in self.scan(text))])

    def strange(self, text: str) -> float:
        """How far the bigrams of a text are below the rate of a usual one."""
        return float(self.weight[bigrams(text)].sum())

    def sounder(self, new: str | None, old: str, share: float = 1.0) -> bool:
        """Whether a stretch set right is less strange, by a share of the margin and by two fifths; what both have at their ends is left out."""
        if new is None or new == old:
            return False
        a = len(commonprefix([new, old]))
        z = len(commonprefix([new[a:][::-1], old[a:][::-1]]))
        new, old = new[max(0, a - 1) : len(new) - max(0, z - 1)], old[max(0, a - 1) : len(old) - max(0, z - 1)]
        was, now = self.strange(old), self.strange(new)
        return was - now >= share * self.margin and now < 0.6 * was


#: Bigrams that may tell something: with a byte beyond ASCII or a question mark.
_TELLING = np.array([max(i >> 8, i & 255) > 127 or 63 in (i >> 8, i & 255) for i in range(65536)])


def _counts(texts: list[str]) -> np.ndarray:
    """How often each telling bigram occurs."""
    total = np.zeros(65536, "f8")
    for at in range(0, len(texts), 500):
        total += np.bincount(bigrams("\n".join(texts[at : at + 500])), minlength=65536)
    total[~_TELLING] = 0
    return total


def train(texts: list[str], rounds: int = 3, chains: list[tuple[str, str, int]] = CHAINS) -> Model:
    """A multinomial model of clean text and of each chain, from texts most of whose lines are sound.

    A chain is trained on the lines that its true encoding can write. Its bigrams are held against those of the
    same lines before garbling and against those of all lines, whichever is likelier, so that a chain's
    languages are no evidence for it. Each round leaves out the lines that the round before takes for garbled.
    """
    clean = list(dict.fromkeys(x for t in texts for x in t.split("\n") if x and (not x.isascii() or "?" in x) and not re.search("[\x80-\x9f\ufffd\ue000-\uf8ff]|\\?\\?", x)))
    model = None
    for k in range(rounds):
        if model is not None:
            clean = [x for x in clean if not judge(model, x)]
        lines = clean if k == rounds - 1 else clean[:FIRST_LINES]
        everything = _counts(lines)
        writable = {true: lines if true == "utf-8" else [x for x in lines if to_bytes(x, true) is not None] for true in {c[0] for c in chains if c[0] != c[1]}}
        ratio = np.empty((len(chains), 65536), "f4")
        for i, chain in enumerate(chains):
            own = writable[chain[0]] if chain[0] != chain[1] else lines
            # no encoding takes a line's end for part of a character, so that lines can be garbled together
            before, after = _counts(own), _counts([garble("\n".join(own[at : at + 500]), chain) for at in range(0, len(own), 500)])
            # rates for the same amount of text: what a chain leaves alone is no evidence, whatever else it does
            usual = np.maximum(before, everything * max(1, before.sum()) / max(1, everything.sum()))
            ratio[i] = np.log(after + 0.5) - np.log(usual + 0.5)
        ratio[:, ~_TELLING] = DULL
        model = Model(chains, np.clip(ratio, LEAST, MOST), np.where(_TELLING, np.log(np.maximum(1, len(lines) * USUAL / (everything + 0.5))), 0), MARGIN if k == rounds - 1 else MARGIN / 2)
    return model


def _piece(text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch of bytes as a stretch of characters, widened to the runs of non-ASCII characters at both ends."""
    data = text.encode("utf-8", "surrogatepass")
    while start > 0 and data[start - 1] >= 128:
        start -= 1
    while start < len(data) and 128 <= data[start] < 192:
        start += 1
    while end < len(data) and data[end] >= 128:
        end += 1
    a = len(data[:start].decode("utf-8", "surrogatepass"))
    return a, a + len(data[start:end].decode("utf-8", "surrogatepass"))


@cache
def _begins(wrong: str) -> re.Pattern | None:
    """What the first two bytes of a character in UTF-8 look like in a charset of single bytes; None for others."""
    if wrong not in _SINGLE:
        return None
    one = _decoding(wrong)
    return re.compile(f"[{re.escape(''.join(one[0xC2:0xF5]))}][{re.escape(''.join(one[0x80:0xC0]))}]")


def _back(text: str, chain: tuple[str, str, int]) -> str:
    """The text with every part set right that the chain strictly inverts: a line, a word, a run beyond ASCII, or what the wrong encoding can write of it."""
    whole = invert(text, chain)
    if whole is not None:
        return whole
    for split in (r"(\n)", r"([ \t]+)", r"([\x00-\x7f]+)"):
        parts = re.split(split, text)
        if len(parts) > 1:
            return "".join(x if x.isascii() else _back(x, chain) for x in parts)
    runs = [(fits, "".join(x)) for fits, x in groupby(text, lambda x: to_bytes(x, chain[1]) is not None)]
    return "".join((invert(x, chain) or x) if fits else x for fits, x in runs) if len(runs) > 1 else text


#: What characters that a charset lacks leave behind.
_LOST = re.compile(r"[^\W\d_]\?[^\W\d_]|\?\?|(^|\s)\?[^\W\d_]")


#: All that can be found at all, for Java: a character beyond ASCII, or question marks where ``_LOST`` sees them in ASCII.
_SUSPECT = r"[^\x00-\x7f]|[A-Za-z]\?[A-Za-z]|\?\?|(?:^|[\s\x1c-\x1f])\?[A-Za-z]"


@dataclass
class Finding:
    chain: tuple[str, str, int]
    start: int
    end: int
    fixed: str | None


def findings(model: Model, text: str) -> Iterator[Finding]:
    """The garbled stretches of a text that stand the check of their chains, the likeliest first: one a chain at most.

    UTF-8 read as something else must come back as valid text whose bigrams are less strange. Of other
    chains the stretch set right must be strictly decodable and look far sounder as well. Of lost characters, their marks must be there.
    """
    lost = text.find("\ufffd")
    for score, c, start, end in model.scan(text):
        chain = model.chains[c]
        a, b = _piece(text, start, end)
        piece = text[a:b]
        if chain[0] == chain[1]:
            if score >= ALONE / 2 and _LOST.search(piece):
                yield Finding(chain, a, b, None)
        elif chain[1] == "utf-8":
            continue
        elif chain[0] == "utf-8":
            if (begins := _begins(chain[1])) and not begins.search(piece):
                continue  # no character of UTF-8 begins in it
            fixed = _back(piece, chain)
            if model.sounder(fixed, piece, 0.4):  # valid UTF-8 is evidence of its own
                yield Finding(chain, a, b, fixed)
        elif score >= ALONE:
            fixed = invert(piece, chain)
            if model.sounder(fixed, piece) and model.worst(fixed) < score / 2:
                yield Finding(chain, a, b, fixed)
            elif score >= 3 * ALONE and model.strange(piece) >= 4 * model.margin:
                yield Finding(chain, a, b, None)
    if lost >= 0:
        yield Finding(("cp1252", "utf-8", 1), lost, lost + 1, None)


def judge(model: Model, text: str) -> Finding | None:
    """The likeliest garbled stretch of a text; None for sound text."""
    return next(findings(model, text), None)


def restore(model: Model, text: str) -> tuple[str, list[str], bool]:
    """(text set right, chains found, whether nothing garbled is left).

    Stretch after stretch is inverted, the likeliest first, until none is left that can be. Then a stretch that can't
    be inverted stays as it is and parts the text; it and what lies before and behind it are each gone on with.
    """
    names: list[str] = []
    whole = True
    done: list[str] = []
    rest, seen = [text], set()  # the next part is the last; texts met, so that no two chains undo each other for ever
    while rest:
        part = rest.pop()
        lost = fixable = None
        for f in findings(model, part):
            if f.fixed is None:
                lost = lost or f
                continue
            true, wrong, times = f.chain
            fixed = part[: f.start] + f.fixed + part[f.end :]
            if true == "utf-8":
                fixed = _back(fixed, f.chain)
            if fixed not in seen:
                fixable = f
                break
        found = fixable or lost
        if not found:
            done.append(part)
            continue
        true, wrong, times = found.chain
        names.append(f"{true} as {wrong}" + " twice" * (times > 1))
        if fixable:
            seen.add(fixed)
            rest.append(fixed)
            continue
        whole = False
        if lost.end - lost.start == len(part):
            done.append(part)
        else:
            rest += [x for x in (part[lost.end :], part[lost.start : lost.end], part[: lost.start]) if x]
    return "".join(done), names, whole


def fit(docs: DataFrame, text: str, keys: list[str], rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Model:
    """The model of a table's texts, from ``lines`` lines at most of ``rows`` rows at most, both chosen by hashes; any place of a text may be drawn."""
    sample = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.xxhash64(*keys).alias("_h"), F.col(text).alias("_t")).orderBy("_h", F.xxhash64("_t")).limit(rows)
    line = sample.select(F.explode(F.regexp_extract_all("_t", F.lit(f"([^\\n]{{1,{TRAIN_PIECE}}})"))).alias("_l")).where(F.col("_l").rlike(_SUSPECT)).distinct()
    return train([r[0] for r in line.orderBy(F.xxhash64("_l"), "_l").limit(lines).collect()])


def find_garbled(docs: DataFrame, keys: list[str], text: str, model: Model | None = None) -> DataFrame:
    """(keys, chains, restored, lossless): rows whose text holds characters that came from a wrong encoding.

    ``chains`` are the chains found, ``restored`` is the text with every stretch set right that strictly decodes,
    ``lossless`` tells whether nothing garbled is left. Null and empty texts are sound; rows repeated in keys and text
    come out once; texts that differ under one key are judged each. Whole texts are read, whatever their length.
    Extra columns are not read.
    """
    model = model or fit(docs, text, keys)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = spread(docs.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")))
    source = source.where(F.col("_text").rlike(_SUSPECT))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", chains string, restored string, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows, chains, fixed, whole = [], [], [], []
            texts = b.column(len(keys)).to_pylist()
            for i, t in enumerate(texts):
                if found := _row(m, t):
                    rows.append(i), chains.append(found[0]), fixed.append(found[1]), whole.append(found[2])
            taken = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(taken.column(k) for k in range(len(keys))), pa.array(chains, pa.string()), pa.array(fixed, pa.string()), pa.array(whole, pa.bool_())], [*keys, "chains", "restored", "lossless"])

    return source.mapInArrow(run, schema).distinct()


#: Bytes that are judged at a time; a longer text is judged part by part, see ``Model.parts``.
_PART = 20_000


def _row(model: Model, text: str) -> tuple[str, str, bool] | None:
    done = [restore(model, p) for p in ([text] if len(text) <= _PART else model.parts(text, _PART))]
    names = list(dict.fromkeys(n for _, ns, _ in done for n in ns))
    return (", ".join(names), "".join(t for t, _, _ in done), all(ok for _, _, ok in done)) if names else None
