"""Subject areas of documents: weighted terms, truncated SVD, cosine to seed centroids refined over the corpus."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread, staged

#: Terms are hashed into this many buckets, so that the model has one size whatever the vocabulary.
BUCKETS = 1 << 15
#: Dimensions kept, passes of subspace iteration over the corpus, rounds of refinement.
DIMS, PASSES, ROUNDS = 64, 3, 3
#: Terms in fewer sentences than this carry no weight.
LEAST_SENTENCES = 5
#: Cosine that a sentence needs to its best centroid, and lead over the best of another subject.
NEAR, LEAD = 0.8, 0.3
#: A document has a subject that this share of its sentences with any subject deal with.
SHARE = 0.25
#: Labelled rows at most that seeds are taken from, by a hash of their text.
SEED_ROWS = 20_000
#: Sentences that samples of this many subjects share deal with none.
COMMON = 3
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_TOKENS, _LONG = 50_000, 64


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()] if text else []


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        b = self[word] = xxhash.xxh64_intdigest(word) % BUCKETS
        return b


_BUCKET = _Buckets()


def encode(sentence: str) -> list[int]:
    """Buckets of a sentence's words, each once."""
    return sorted({_BUCKET[w] for w in _WORD.findall(sentence.casefold())})


def encode_text(text: str | None) -> list[list[int]]:
    return [e for e in map(encode, sentences(text)) if e]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, lists), "i4", len(lists))
    return np.fromiter((i for x in lists for i in x), "i4", int(lens.sum())), lens


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _staged_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ids, lens): buckets of all sentences in a row, and how many each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lens = [], []
            for t in b.column(1).to_pylist():
                e = encode_text(t)
                ids.append([i for x in e for i in x]), lens.append([len(x) for x in e])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(lens, pa.list_(pa.int32()))], [key, "ids", "lens"])

    source = spread(docs.select(key, text))
    return staged(source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, ids array<int>, lens array<int>"), "terms")


def _parts(b: pa.RecordBatch, tokens: int, docs: int = 1 << 30) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lens, row of each id, row of each sentence) of some documents at a time: ``docs`` and about ``tokens`` at most, one document at least."""
    i, n = b.column("ids"), b.column("lens")
    io, no = i.offsets.to_numpy(), n.offsets.to_numpy()
    iv, nv = i.values.to_numpy(), n.values.to_numpy()
    first = 0
    while first < b.num_rows:
        last = min(max(first + 1, int(np.searchsorted(io, io[first] + tokens, "right")) - 1), first + docs, b.num_rows)
        if no[last] > no[first]:
            at = np.arange(first, last)
            yield iv[io[first] : io[last]], nv[no[first] : no[last]], np.repeat(at, np.diff(io[first : last + 1])), np.repeat(at, np.diff(no[first : last + 1]))
        first = last


def _summed(terms: DataFrame, width: int, rows: int, collect: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the (rows, width) array that ``collect`` makes of a task's batches.

    Only rows that a task touched travel; they are added up by a hash aggregation with partial sums, and as
    many rows as the array has come to the driver.
    """
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = collect(batches)
        at = np.flatnonzero(a.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(a[at, k], pa.float64()) for k in range(width))], ["row", *names])

    added = terms.select("ids", "lens").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((rows, width))
    at = added.column("row").to_numpy()
    for k, n in enumerate(names):
        out[at, k] = added.column(n).to_numpy()
    return out


def _documents(batches: Iterator[pa.RecordBatch], idf: np.ndarray, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, matrix): blocks of documents as a dense matrix over the terms the block has, rows of length one."""
    for b in batches:
        for ids, _, row, _ in _parts(b, 1 << 20, size):
            pair, n = np.unique((row - row[0]) * len(idf) + ids, return_counts=True)
            doc, term = np.divmod(pair, len(idf))
            v = (1 + np.log(n)) * idf[term]
            length = np.sqrt(np.bincount(doc, v * v))[doc]
            some = v > 0
            if some.any():
                terms, at = np.unique(term[some], return_inverse=True)
                m = np.zeros((doc[-1] + 1, len(terms)), "f4")
                m[doc[some], at] = v[some] / length[some]
                yield terms, m


@contextmanager
def _shared(terms: DataFrame, value) -> Iterator:
    """A broadcast for the length of a pass; afterwards neither driver nor executors keep its files."""
    b = terms.sparkSession.sparkContext.broadcast(value)
    try:
        yield b
    finally:
        b.destroy()


@dataclass
class Model:
    """Weights and directions of terms, centroids of subjects (one for each language) and of sentences about none."""

    subjects: list[str]
    weight: np.ndarray
    basis: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    none: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}  # each task makes its own

    def embed(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Unit vectors of sentences."""
        table = self.__dict__.get("_table")
        if table is None:
            table = self.__dict__["_table"] = self.basis * self.weight[:, None]
        start = np.cumsum(lens) - lens
        order = np.argsort(-lens, kind="stable")
        out = np.zeros((len(lens), self.basis.shape[1]), "f4")
        # the p-th words of all sentences at once, longest sentences first; the rest of long ones by itself
        longer = np.searchsorted(-lens[order], -np.arange(min(int(lens.max()), _LONG)), "left")
        for p, k in enumerate(longer):
            out[:k] += table[ids[start[order[:k]] + p]]
        for r in range(int((lens > _LONG).sum())):
            at = start[order[r]] + _LONG
            for i in range(at, start[order[r]] + lens[order[r]], _TOKENS):
                out[r] += table[ids[i : min(i + _TOKENS, start[order[r]] + lens[order[r]])]].sum(axis=0)
        unit = np.empty_like(out)
        unit[order] = _unit(out)
        return unit

    def classify(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, best centroid, its cosine, lead over other subjects, cosine to sentences about none)."""
        u = self.embed(ids, lens)
        a = u @ self.centroids.T
        best = a.argmax(axis=1)
        top = a[np.arange(len(a)), best]
        others = np.where(self.owner[None, :] == self.owner[best][:, None], -1.0, a).max(axis=1)
        none = (u @ self.none.T).max(axis=1) if len(self.none) else np.full(len(u), -1.0, "f4")
        return u, best, top, top - others, none


def fit(terms: DataFrame, samples: list[tuple[str, str | None, str]], buckets: int = BUCKETS, dims: int = DIMS) -> Model | None:
    """A model from labelled samples (subject, language, text) and all documents; None without samples or documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros((buckets + 1, 1))
        for b in batches:
            for ids, lens, _, _ in _parts(b, 1 << 20):
                n[:buckets, 0] += np.bincount(ids, minlength=buckets)
                n[buckets, 0] += len(lens)
        return n

    seen = _summed(terms, 1, buckets + 1, count)[:, 0]
    total = seen[buckets]
    if not total or not samples:
        return None
    idf = np.where(seen[:buckets] >= LEAST_SENTENCES, np.log((total + 1) / (seen[:buckets] + 1)), 0.0).astype("f4")
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((buckets, dims)))[0].astype("f4")
    y = None
    for _ in range(PASSES):
        with _shared(terms, (q, idf)) as shared:

            def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
                q, idf = shared.value
                out = np.zeros(q.shape, "f4")
                for at, m in _documents(batches, idf):
                    out[at] += m.T @ (m @ q[at])
                return out

            y = _summed(terms, dims, buckets, multiply)
        before, q = q, np.linalg.qr(y)[0].astype("f4")
    # rotation to singular vectors: before^T (A^T A) before is small and symmetric
    values, turn = np.linalg.eigh((before.T @ y + y.T @ before) / 2)
    order = np.argsort(-values)
    sigma = np.sqrt(np.maximum(values[order], 0))
    # what all documents share, the first direction, tells nothing; the others count by their strength, up to the second's
    scale = np.minimum(sigma, sigma[min(1, dims - 1)])
    scale[0] = 0
    basis = (before @ turn[:, order] * scale).astype("f4")

    subjects = sorted({s for s, _, _ in samples})
    texts, labels, langs = [], [], []
    for s, lang, t in samples:
        for x in sentences(t):
            if encode(x):
                texts.append(re.sub(r"\d+", "#", x.strip())), labels.append(subjects.index(s)), langs.append(lang or "")
    if not texts:
        return None
    under = defaultdict(set)
    for x, s in zip(texts, labels, strict=True):
        under[x].add(s)
    common = np.array([len(under[x]) >= COMMON for x in texts])
    labels_, langs_, texts_ = np.array(labels), np.array(langs), np.array(texts, dtype=object)
    ids, lens = _flat([encode(x) for x in texts])
    keys = [(s, lang) for s in range(len(subjects)) for lang in sorted(set(langs)) if ((labels_ == s) & (langs_ == lang) & ~common).any()]
    phrases = sorted(set(texts_[common]))
    model = Model(subjects, idf, basis, np.empty((0, dims)), np.array([s for s, _ in keys]), np.empty((0, dims)))

    def seeds(m: Model) -> tuple[np.ndarray, np.ndarray]:
        u = m.embed(ids, lens)
        c = _unit(np.stack([u[(labels_ == s) & (langs_ == lang) & ~common].mean(axis=0) for s, lang in keys]))
        return c, _unit(np.stack([u[texts_ == p].mean(axis=0) for p in phrases])) if phrases else np.empty((0, dims))

    model.centroids, model.none = seeds(model)
    for k in range(ROUNDS):
        with _shared(terms, model) as shared:

            def gather(batches: Iterator[pa.RecordBatch], shared=shared, near=0.35 if k == 0 else 0.6) -> np.ndarray:
                m = shared.value
                width = len(m.subjects) + 1
                out = np.zeros(buckets * width)
                for b in batches:
                    for i, n, _, _ in _parts(b, _TOKENS):
                        _, best, top, _, none = m.classify(i, n)
                        about = (top > near) & (top > none)
                        cls = np.where(about, m.owner[best], len(m.subjects))
                        use = about | (none > 0.6)
                        at = np.repeat(use, n)
                        out += np.bincount(i[at].astype("i8") * width + np.repeat(cls, n)[at], minlength=len(out))
                return out.reshape(buckets, width)

            by_class = _summed(terms, len(subjects) + 1, buckets, gather)
        n = by_class.sum(axis=1)
        p = by_class / np.maximum(n, 1)[:, None]
        spread = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1) / np.log(len(subjects) + 1)
        # a term that subjects share evenly tells nothing; a rare one little
        telling = np.where(n >= LEAST_SENTENCES, np.maximum(0, 1 - 1.6 * spread), 0.3)
        model = Model(subjects, (idf * telling).astype("f4"), basis, model.centroids, model.owner, model.none)
        # the seeds keep a say of a few sentences, so that a centroid can't drift off them
        seeded, model.none = seeds(model)
        model.centroids = _recentred(terms, model, seeded)
    return model


def _recentred(terms: DataFrame, model: Model, seeded: np.ndarray) -> np.ndarray:
    """Centroids under the model's present weights, from all sentences near the seeds' ones."""
    start = Model(model.subjects, model.weight, model.basis, seeded, model.owner, model.none)
    dims = model.basis.shape[1]

    with _shared(terms, start) as shared:

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            m = shared.value
            out = np.zeros((len(m.centroids), dims))
            for b in batches:
                for i, n, _, _ in _parts(b, _TOKENS):
                    u, best, top, _, none = m.classify(i, n)
                    about = (top > 0.35) & (top > none)
                    out += ((best == np.arange(len(out))[:, None]) & about).astype("f4") @ u
            return out

        found = _summed(terms, dims, len(seeded), gather)
    return _unit(_unit(found) + 0.2 * seeded).astype("f4")


def assign(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject, share): subjects that at least SHARE of a document's sentences with any subject deal with.

    samples has ``subject``, ``lang`` and ``text``; a few may be labelled wrongly. Null, empty and wordless texts have no
    subject; repeated documents come out as often as they go in; without samples nothing comes out. Whole texts are read.
    Extra columns are not read. All documents shape term weights, directions and centroids.
    """
    kind = f"`{key}` {docs.schema[key].dataType.simpleString()}, subject string, share double"
    spark = docs.sparkSession
    rows = samples.where("subject IS NOT NULL AND text IS NOT NULL").select("subject", "lang", "text", F.xxhash64("text").alias("_h")).orderBy("_h", "subject").limit(SEED_ROWS).collect()
    terms = _staged_terms(docs, key, text)
    model = fit(terms, [(r[0], r[1], r[2]) for r in rows])
    if model is None:
        return spark.createDataFrame([], kind)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at, who, shares = [], [], []
            for ids, lens, _, row in _parts(b, _TOKENS):
                _, best, top, lead, none = m.classify(ids, lens)
                on = (top >= NEAR) & (lead >= LEAD) & (top > none)
                width = len(m.subjects)
                n = np.bincount((row[on] - row[0]) * width + m.owner[best[on]], minlength=(row[-1] - row[0] + 1) * width).reshape(-1, width)
                total = n.sum(axis=1, keepdims=True)
                r, s = np.nonzero((n > 0) & (n >= SHARE * total))
                at.append(r + row[0]), who.append(s), shares.append(n[r, s] / total[r, 0])
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), pa.array([m.subjects[s] for s in np.concatenate(who)], pa.string()), pa.array(np.concatenate(shares).astype("f8"))], [key, "subject", "share"])

    return terms.mapInArrow(run, kind)
