"""Most similar vectors for every vector: NN-descent over Spark joins, and greedy search of its graph.

Rows whose unit vectors agree as 16-bit floats form a class and are searched once. Each class belongs to a few small blocks of
nearby classes, one in each of PARTS partitions of the table, and starts with the nearest of its blocks, which is a poor list.
Rounds of descent then better all lists: the hosts of a block gather their neighbours and those they are a neighbour of, and all
that a block has gathered are introduced to each other, save those that know each other. A gathered vector travels once to the
blocks of a group, not once a host, as 8-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import spread, staged

#: Neighbours asked for of every vector, and neighbours its list holds during the descent.
K, HELD = 10, 16
#: Vectors a pivot's cell has on average, pivots of a model at most, vectors of all models that pivots are fitted on at most.
CELL, PIVOTS, SAMPLE = 2000, 8192, 40_000
#: Hosts of a block at most, partitions of the table into blocks, vectors a cell may have before it is dealt out by a hash.
BLOCK, PARTS, CROWD = 256, 3, 16_000
#: Neighbours a host brings to its block, and those at most it is a neighbour of; of what a vector meets in a block, how many go on.
INTRODUCED, NAMED, SENT = 10, 5, 8
#: Rounds of descent at most; it ends once a round renews a smaller share of the list entries.
ROUNDS, SETTLED = 8, 0.03
#: What cosines of 8-bit integers, and those of 16-bit floats, may be wrong by.
COARSE, DOUBT = 1e-2, 1e-3
#: Vectors of a group of cells about, which a task works through at once: a thousandth of all within these bounds, as packets are parts times groups.
GROUP, WIDEST = 16_000, 64_000
#: Lists kept in a part at most, about; vectors of a packed row at most, and those compared to a block at a time.
PART, PACK, STEP = 200_000, 4096, 256
#: The block of a vector in a partition of which nothing is known yet; numbers of groups, which lead the 40 bits of cell and block.
_NOWHERE, _GROUPS = -(1 << 63), 1 << 23


def _schema(numbers: str, arrays: str) -> pa.Schema:
    kinds = {c: pa.int32() for c in ("part", "m", "deal", "n")}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in numbers.split()] + [(c, pa.binary()) for c in arrays.split()])


#: Rows are packed: a row has the vectors or lists of many keys, as binary values which Spark moves without looking inside.
_CELLS = _schema("part m grp cell deal n", "keys small")
_LISTS = _schema("part m entries gained", "keys homes small lens ids sims")
_ASKS = _schema("part m", "host member block")
_WANTS = _schema("part m", "member block small worst lens known")
_PARCELS = _schema("m grp", "keys small worst lens known slot block")


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'bigint'}).get(f.type, 'binary')}" for f in schema)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of 16-bit floats as a matrix of 32-bit ones."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(c):
        return np.zeros((0, 1), "f4")
    off = np.frombuffer(c.buffers()[1], "i4")[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], "f2", count=(off[-1] - off[0]) // 2, offset=int(off[0])).reshape(len(c), -1).astype("f4")


def _offsets(lens: np.ndarray, width: int = 1) -> np.ndarray:
    off = np.zeros(len(lens) + 1, "i4")
    np.cumsum(lens * width, out=off[1:])
    return off


def _lists(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(lens)), pa.array(values, kind))


def unit_vectors(vectors: DataFrame, contracts: DataFrame) -> DataFrame:
    """(m, key, vec): model number, ``file_id << 16 | frame_idx`` and unit vector of every valid row.

    A row is valid when its vector is not null, has as many numbers as its model's dims, all of them finite and
    not all zero. Rows of unknown models or with a null id are left out. Repeated rows stay repeated.
    """
    dims = {r[0]: (i, r[1]) for i, r in enumerate(sorted(map(tuple, contracts.where("model_version IS NOT NULL AND dims > 0").select("model_version", "dims").distinct().collect())))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = (b.column("file_id").to_numpy(zero_copy_only=False).astype("i8") << 16) | b.column("frame_idx").to_numpy(zero_copy_only=False).astype("i8")
            models = np.array(b.column("model_version").to_pylist(), dtype=object)
            v = b.column("vector")
            off, values = v.offsets.to_numpy(), v.values
            data = values.to_numpy(zero_copy_only=False).astype("f4")  # null elements become NaN
            size = np.diff(off)
            for name, (m, d) in dims.items():
                at = np.flatnonzero((models == name) & (size == d) & ~np.asarray(v.is_null()))
                if not len(at):
                    continue
                x = data[off[at][:, None] + np.arange(d)]
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[fine], x[fine].astype("f8")
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                raw = np.ascontiguousarray(x.astype("f2") + np.float16(0))
                flat = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * 2 * d, 2 * d, dtype="i4").tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, "i4")), pa.array(keys[at]), flat], ["m", "key", "vec"])

    source = vectors.where("file_id IS NOT NULL AND frame_idx IS NOT NULL AND model_version IS NOT NULL AND vector IS NOT NULL").select("file_id", "frame_idx", "model_version", "vector")
    return spread(source).mapInArrow(run, "m int, key bigint, vec binary")


def _pivots(reps: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pivots, planes, groups of the pivots) of each model; groups of all models are numbered through.

    Pivots come from spherical k-means on a bounded sample, of which each model has an equal part or all its rows, so that dense
    regions get more of them. Where cells would be larger than CELL, random planes through each pivot halve them.
    """
    counts = {r[0]: r[1] for r in reps.groupBy("m").count().collect()}
    if not counts:
        return {}
    part = max(1, SAMPLE // len(counts))
    chance = F.element_at(F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, int(min(1.0, part / n) * (1 << 20)) + 1)]), F.col("m"))
    drawn = reps.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < chance).select("m", "key", "vec").orderBy(F.xxhash64("key")).limit(2 * SAMPLE).toArrow()
    m = drawn.column("m").to_numpy()
    out, made = {}, 0
    for model, n in counts.items():
        x = _matrix(drawn.filter(pa.array(m == model)).column("vec"))
        if not len(x):  # hardly any row of a small model: one cell at no place
            x = _matrix(reps.where(F.col("m") == model).select("vec").limit(1).toArrow().column("vec"))
        c = max(1, min(PIVOTS, n // CELL, len(x)))
        p, share = x[:c].copy(), np.ones(c)
        for _ in range(3 if c > 1 else 0):
            near = np.concatenate([(x[i : i + 4096] @ p.T).argmax(axis=1) for i in range(0, len(x), 4096)])
            order = np.argsort(near, kind="stable")
            seen, first = np.unique(near[order], return_index=True)
            total = np.add.reduceat(x[order], first)
            p[seen] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
            share = np.bincount(near, minlength=c)
        halvings = max(0, int(np.ceil(np.log2(n / (2 * c * CELL)))))
        groups = made + _bisected(p, np.random.default_rng(model), min(WIDEST, max(GROUP, sum(counts.values()) // 1000)), share * (n / share.sum()))
        out[model] = p, np.random.default_rng(model).standard_normal((p.shape[1], halvings)).astype("f4"), groups
        made = int(groups.max()) + 1
    return out


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first."""
    k = min(k, sims.shape[1])
    at = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)


def _small(x: np.ndarray) -> np.ndarray:
    """Vectors as 8-bit integers, each by its own scale: what is left of their direction is true to about a thousandth of the cosine."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9))).astype("i1")


def _directions(small: np.ndarray) -> np.ndarray:
    """Rows of 8-bit integers as unit vectors."""
    x = small.astype("f4")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _bisected(x: np.ndarray, rng: np.random.Generator, most: int, weight: np.ndarray | None = None) -> np.ndarray:
    """A number of a block for each vector: halves along a random direction of large variance, until no block of several exceeds ``most``, by weight."""
    block, todo, made = np.zeros(len(x), "i8"), [np.arange(len(x))], 0
    while todo:
        at = todo.pop()
        if len(at) == 1 or (len(at) if weight is None else weight[at].sum()) <= most:
            block[at] = made
            made += 1
            continue
        y = x[at] - x[at].mean(axis=0)
        d = rng.standard_normal(x.shape[1]).astype("f4")
        for _ in range(2):
            d = y.T @ (y @ d)
            d /= max(np.linalg.norm(d), 1e-9)
        order = np.argsort(y @ d, kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return block


def _hashed(ids: np.ndarray, turn: int = 0) -> np.ndarray:
    """64 bits of a hash of each id, another one each turn."""
    h = (ids.astype("i8").view("u8") ^ np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _spot(cell: dict, deal: int) -> int:
    """A hash of a cell and a deal of it."""
    first = _hashed(np.array([(cell["m"] * PARTS + cell["part"]) << 32 | deal])).view("i8")
    return int(_hashed(first ^ cell["cell"])[0])


def _distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, which is slower by hashing."""
    v = np.sort(values)
    return v[np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]])]


def _marks(ids: np.ndarray, turn: int) -> np.ndarray:
    """16 bits that stand for each id this turn."""
    return (_hashed(ids, turn) >> np.uint64(48)).astype("u2")


def _nearest(lens: np.ndarray, n: int) -> np.ndarray:
    """Whether each entry of the lists is among the first n of its list."""
    return np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) < n


def _falling(sims: np.ndarray) -> np.ndarray:
    """32-bit integers in the reverse order of the cosines."""
    bits = sims.astype("f4").view("u4")
    return np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))


def _true(ok: np.ndarray) -> np.ndarray:
    """Places of the true values of a flattened array, few of which are true: eight are looked at at once."""
    flat = ok.reshape(-1)
    whole = len(flat) & ~7
    eights = np.flatnonzero(flat[:whole].view("u8"))
    at = np.flatnonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[at >> 3] << 3 | at & 7, whole + np.flatnonzero(flat[whole:])])


def _better(x: np.ndarray, worst: np.ndarray, k: int, marks: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, columns, cosines) of the at most k nearest others of each vector that beat its ``worst`` and, by their ``marks``, aren't in its row of ``known``."""
    n, most = len(x), k + (0 if known is None else known.shape[1])
    lens, cols, sims = np.zeros(n, "i8"), [], []
    wide, every = n // 8, x @ x.T  # of an array and itself numpy reckons one half and mirrors it
    every.reshape(-1)[:: n + 1] = -2
    for i in range(0, n, STEP):
        s, least = every[i : i + STEP], worst[i : i + STEP]
        ok = s > least[:, None]
        if wide > most and np.count_nonzero(ok) > most * len(s):
            # ``most`` of the maxima of every eighth column reach this, so at least as many cosines do
            tops = s[:, :wide].copy()
            for j in range(1, 8):
                np.maximum(tops, s[:, j * wide : (j + 1) * wide], out=tops)
            tops.partition(wide - most, axis=1)
            ok = s > np.maximum(least, np.nextafter(tops[:, wide - most], np.float32(-3)))[:, None]
        at, c = np.divmod(_true(ok), n)
        if known is not None:
            fresh = (known[i + at] != marks[c, None]).all(axis=1)
            at, c = at[fresh], c[fresh]
        each = np.bincount(at, minlength=len(s))
        found = s[at, c]
        if each.max(initial=0) > k:
            o = np.argsort((at.astype("u8") << np.uint64(32)) | _falling(found), kind="stable")
            o = o[_nearest(each, k)]
            at, c, found = at[o], c[o], found[o]
            each = np.minimum(each, k)
        lens[i : i + STEP] = each
        cols.append(c), sims.append(found)
    return lens, np.concatenate(cols), np.concatenate(sims)


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition in which each key's list is kept."""
    return (_hashed(keys) >> np.uint64(33)).astype("i8") % parts


def _dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, places of its keys)."""
    part = _parts(keys, parts)
    order = np.argsort(part.astype("u2") if parts <= 1 << 16 else part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _dealt_lists(keys: np.ndarray, lens: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, places of its keys, places of the entries of their lists)."""
    first = np.cumsum(lens) - lens
    for to, at in _dealt(keys, parts):
        n = lens[at]
        yield to, at, np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _packed(values: np.ndarray) -> bytes:
    """An array compressed by the places of its bytes: the high ones of keys and cosines are much alike."""
    raw = np.ascontiguousarray(values).reshape(-1)
    planes = raw.view("u1").reshape(-1, raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _number(value: bytes | None, kind: str) -> np.ndarray:
    """The array of a packed value, empty for none."""
    if not value:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, "u1").reshape(width, -1).T.copy().view(kind)[:, 0] if width > 1 else np.frombuffer(planes, kind)


def _row(**values: int | np.ndarray | None) -> dict:
    return {k: _packed(v) if isinstance(v, np.ndarray) else v for k, v in values.items()}


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(model, its packed rows) of a partition."""
    own: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            own.setdefault(r["m"], []).append(r)
    yield from sorted(own.items())


def _lens(r: dict) -> np.ndarray:
    return _number(r["lens"], "u2").astype("i8")


def _first_lists(reps: DataFrame, k: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The start of the graph: for each vector and partition into blocks its block there and the nearest ones of that block, packed; and a staged table to drop.

    A vector goes to the cells of its PARTS nearest pivots, and the blocks are cut out of cells. A cell of more than CROWD
    vectors (near copies that no plane parts) is dealt out by a hash, so that no task gets more; the descent joins it up again.
    A block's number begins with that of its group: of the cells of some pivots near each other, or what was dealt of a crowded cell.
    """
    shared = reps.sparkSession.sparkContext.broadcast(_pivots(reps))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            m = b.column("m").to_numpy()
            for model in np.unique(m):
                own = b.filter(pa.array(m == model))
                x, (p, planes, groups) = _matrix(own.column("vec")), pivots[int(model)]
                near = np.concatenate([_top(x[i : i + 2048] @ p.T, PARTS) for i in range(0, len(x), 2048)]).astype("i8")
                keys, small, rows = own.column("key").to_numpy(), _small(x), []
                wide = max(0, planes.shape[1] - 2)  # of a pivot with many cells each four make a group
                for part in range(PARTS):
                    c = near[:, min(part, near.shape[1] - 1)]
                    side = ((x - p[c]) @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype="i8"))
                    group, cell = ((groups[c] << wide) + (side >> (planes.shape[1] - wide))) * PARTS + part, (c << planes.shape[1]) + side
                    order = np.argsort(cell, kind="stable")
                    for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                        rows.append(_row(part=part, m=int(model), grp=int(group[at[0]]), cell=int(cell[at[0]]), deal=0, n=len(at), keys=keys[at], small=small[at]))
                yield from _table(rows, _CELLS).to_batches()

    placed = staged(reps.mapInArrow(cells, _ddl(_CELLS)), "cells")
    crowds = {(r.m, r.part, r.cell): -(-r.n // CROWD) for r in placed.groupBy("m", "part", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if deals := crowds.get((r["m"], r["part"], r["cell"])):
                    keys, small = _number(r["keys"], "i8"), _number(r["small"], "i1").reshape(r["n"], -1)
                    deal = (_hashed(keys, r["part"]) >> np.uint64(33)).astype("i8") % deals
                    rows += [_row(**r | {"grp": _spot(r, int(d)) % _GROUPS, "deal": int(d), "n": int((deal == d).sum()), "keys": keys[deal == d], "small": small[deal == d]}) for d in np.unique(deal)]
                else:
                    rows.append(r)
            yield from _table(rows, _CELLS).to_batches()

    def started(rows: list[dict]) -> tuple[np.ndarray, ...]:
        r, keys = rows[0], np.concatenate([_number(r["keys"], "i8") for r in rows])
        part, small = r["part"], np.concatenate([_number(r["small"], "i1") for r in rows]).reshape(len(keys), -1)
        x = _directions(small)
        base = (r["grp"] % _GROUPS << 40) | (_spot(r, r["deal"]) % (1 << 24) << 16)
        block = _bisected(x, np.random.default_rng(part), BLOCK)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(block.max() + 2))
        lens, ids, sims = [], [], []
        for i, j in zip(edges, edges[1:], strict=False):
            own = order[i:j]
            n, c, s = _better(x[own], np.full(len(own), -2, "f4"), k)
            lens.append(n), ids.append(keys[own[c]]), sims.append(s)
        homes = np.full((len(keys), PARTS), _NOWHERE)
        homes[:, part] = base | block[order]
        return keys[order], homes, small[order], np.concatenate(lens), np.concatenate(ids), np.concatenate(sims)

    def inside(t: pa.Table) -> pa.Table:
        cells: dict[tuple[int, int], list[dict]] = {}
        for r in t.to_pylist():
            cells.setdefault((r["cell"], r["deal"]), []).append(r)
        made = [started(rows) for _, rows in sorted(cells.items())]  # of each cell its keys, homes, 8-bit vectors, lengths, ids, cosines
        keys, homes, small, lens, ids, sims = (np.concatenate(x) for x in zip(*made, strict=True))
        m, part = t.column("m")[0].as_py(), t.column("part")[0].as_py()
        rows = []
        for to, at, mine in _dealt_lists(keys, lens, parts):
            rows.append(_row(part=to, m=m, keys=keys[at], homes=homes[at], small=small[at] if part == 0 else None, lens=lens[at].astype("u2"), ids=ids[mine], sims=sims[mine], entries=0, gained=0))
        return _table(rows, _LISTS)

    whole = placed.mapInArrow(dealt, _ddl(_CELLS)) if crowds else placed
    return whole.groupBy("m", "part", "grp").applyInArrow(inside, _ddl(_LISTS)), placed


def _merged(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """One list for each key from all its lists: each neighbour once, the k nearest, ties by a hash of the neighbour.

    ``entries`` counts what the lists hold, ``gained`` what of it came from rows without homes, which are those of a round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, rows in _by_model(batches):
            part = rows[0]["part"]
            rows.sort(key=lambda r: not r["homes"])
            held = [_number(r["keys"], "i8") for r in rows]
            uniq, inv = np.unique(np.concatenate(held), return_inverse=True)
            lens = np.concatenate([_lens(r) for r in rows])
            new = np.repeat(np.repeat([not r["homes"] for r in rows], [len(x) for x in held]), lens)
            ids, sims = np.concatenate([_number(r["ids"], "i8") for r in rows]), np.concatenate([_number(r["sims"], "f4") for r in rows])
            homes, small, at = np.full((len(uniq), PARTS), _NOWHERE), None, 0
            for r, own in zip(rows, held, strict=True):
                to, at = inv[at : at + len(own)], at + len(own)
                if r["homes"]:
                    homes[to] = np.maximum(homes[to], _number(r["homes"], "i8").reshape(-1, PARTS))
                if r["small"]:
                    x = _number(r["small"], "i1").reshape(len(own), -1)
                    small = np.zeros((len(uniq), x.shape[1]), "i1") if small is None else small
                    small[to] = x
            who = np.repeat(inv, lens)
            o = np.lexsort((new, ids, who)) if len(uniq) >> 24 else np.argsort((who.astype("u8") << np.uint64(40)) | (_hashed(ids) >> np.uint64(25) << np.uint64(1)) | new.astype("u8"), kind="stable")
            keep = np.ones(len(o), bool)  # an entry known before goes before the same one anew
            keep[1:] = (who[o][1:] != who[o][:-1]) | (ids[o][1:] != ids[o][:-1])
            o = o[keep]
            o = o[np.argsort((who[o].astype("u8") << np.uint64(32)) | _falling(sims[o]), kind="stable")]
            n = np.bincount(who[o], minlength=len(uniq))
            o = o[_nearest(n, k)]
            n = np.minimum(n, k)
            gained = np.bincount(who[o], new[o], len(uniq))
            ends = np.concatenate([[0], np.cumsum(n)])
            for i in range(0, len(uniq), PACK):
                j = min(i + PACK, len(uniq))
                own = o[ends[i] : ends[j]]
                yield _table([_row(part=part, m=m, keys=uniq[i:j], homes=homes[i:j], small=small[i:j], lens=n[i:j].astype("u2"), ids=ids[own], sims=sims[own], entries=len(own), gained=int(gained[i:j].sum()))], _LISTS).to_batches()[0]

    return lists.repartitionById(parts, "part").mapInArrow(run, _ddl(_LISTS))


def _introductions(graph: DataFrame, turn: int, parts: int, held: int, introduced: int) -> DataFrame:
    """New list entries: all that the hosts of a block gather are compared to each other.

    A host brings itself, its ``introduced`` nearest and, of the vectors that name it among theirs, NAMED at most by a
    hash, as the descent's sampling; so a block never has more than BLOCK times that. Of what a vector meets in one block the
    SENT best that it doesn't know yet go on; the next rounds bring the others, if they are still better than what it has by then.
    A vector travels once to all blocks of a group, with the marks of those in its list. One candidate in some 4,000 has
    the mark of another by chance and is held back; as marks change each turn, the next round brings it.
    """
    q = turn % PARTS

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each neighbour: who names it, and that one's block."""
        for m, rows in _by_model(batches):
            for i in range(0, len(rows), 64):
                some = rows[i : i + 64]
                keys, homes = np.concatenate([_number(r["keys"], "i8") for r in some]), np.concatenate([_number(r["homes"], "i8").reshape(-1, PARTS)[:, q] for r in some])
                lens = np.concatenate([_lens(r) for r in some])
                brought = _nearest(lens, introduced)
                nbr, who = np.concatenate([_number(r["ids"], "i8") for r in some])[brought], np.repeat(np.arange(len(keys)), np.minimum(lens, introduced))
                o = np.argsort(homes[who], kind="stable")  # packs better by blocks
                nbr, who = nbr[o], who[o]
                out = [_row(part=to, m=m, host=keys[at], member=None, block=homes[at]) for to, at in _dealt(keys, parts)]
                out += [_row(part=to, m=m, host=nbr[at], member=keys[who[at]], block=homes[who[at]]) for to, at in _dealt(nbr, parts)]
                yield from _table(out, _ASKS).to_batches()

    def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(member, block): the hosts themselves, their neighbours, and some that name them."""
        for m, rows in _by_model(batches):
            joined = lambda name, some: np.concatenate([np.zeros(0, "i8"), *[_number(r[name], "i8") for r in some]])
            own, edges = [r for r in rows if not r["member"]], [r for r in rows if r["member"]]
            keys, homes = joined("host", own), joined("block", own)
            o = np.argsort(keys)
            keys, homes = keys[o], homes[o]
            nbr, member, block = (joined(c, edges) for c in ("host", "member", "block"))
            host = np.searchsorted(keys, nbr)
            o = np.argsort((host.astype("u8") << np.uint64(40)) | (_hashed(member ^ nbr * 31) >> np.uint64(24)))
            o = o[_nearest(np.bincount(host, minlength=len(keys)), NAMED)]
            to, at = np.concatenate([keys, nbr, member[o]]), np.concatenate([homes, block, homes[host[o]]])
            yield from _table([_row(part=p, m=m, member=to[a], block=at[a]) for p, a in _dealt(to, parts)], _WANTS).to_batches()

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                lens, sims = _lens(r), _number(r["sims"], "f4")
                worst = np.full(len(lens), -2, "f4")
                worst[lens == held] = sims[np.cumsum(lens)[lens == held] - 1]
                known = np.zeros((len(lens), held), "u2")
                known[np.arange(held) < lens[:, None]] = _marks(_number(r["ids"], "i8"), turn)
                rows.append(_row(part=r["part"], m=r["m"], member=r["keys"], block=None, small=r["small"], worst=worst, lens=lens.astype("u2"), known=known))
            yield from _table(rows, _WANTS).to_batches()

    def parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each group: the vectors that its blocks want, and which block wants which."""
        for m, rows in _by_model(batches):
            own = [r for r in rows if r["small"]]
            keys = np.concatenate([_number(r["member"], "i8") for r in own])
            small = np.concatenate([_number(r["small"], "u1") for r in own]).reshape(len(keys), -1)
            worst, lens, known = np.concatenate([_number(r["worst"], "f4") for r in own]), np.concatenate([_number(r["lens"], "u2") for r in own]), np.concatenate([_number(r["known"], "u2") for r in own]).reshape(-1, held)
            order = np.argsort(keys)
            member, block = (np.concatenate([_number(r[c], "i8") for r in rows if r["block"]]) for c in ("member", "block"))
            blocks = _distinct(block)
            pairs = _distinct((np.searchsorted(blocks, block) << 32) | np.searchsorted(keys[order], member))
            block, at = pairs >> 32, pairs & 0xFFFFFFFF
            group = blocks[block] >> 40
            out = []
            for i, j in zip(ends := np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]), ends[1:], strict=False):
                mine, slot = np.unique(at[i:j], return_inverse=True)
                mine = order[mine]
                out.append(_row(m=m, grp=int(group[i]), keys=keys[mine], small=small[mine], worst=worst[mine], lens=lens[mine], known=known[mine], slot=slot.astype("i4"), block=blocks[block[i:j]]))
                if len(out) == 64 or j == len(group):
                    yield from _table(out, _PARCELS).to_batches()
                    out = []

    def inside(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        m, keys = rows[0]["m"], [_number(r["keys"], "i8") for r in rows]
        first = np.cumsum([0, *[len(x) for x in keys]])
        keys = np.concatenate(keys)
        x = _directions(np.concatenate([_number(r["small"], "i1") for r in rows]).reshape(len(keys), -1))
        worst, lens = np.concatenate([_number(r["worst"], "f4") for r in rows]), np.concatenate([_lens(r) for r in rows])
        marks = _marks(keys, turn)
        known = np.where(np.arange(held) < lens[:, None], np.concatenate([_number(r["known"], "u2") for r in rows]).reshape(-1, held), marks[:, None])
        slot, block = np.concatenate([_number(r["slot"], "i4") + f for r, f in zip(rows, first, strict=False)]), np.concatenate([_number(r["block"], "i8") for r in rows])
        o = np.argsort(block, kind="stable")
        slot, block = slot[o], block[o]
        met, sims = [], []
        for own in np.split(slot, np.flatnonzero(np.diff(block)) + 1):
            n, c, s = _better(x[own], worst[own], SENT, marks[own], known[own])
            met.append((np.repeat(own, n).astype("i8") << 32) | own[c]), sims.append(s)
        met, at = np.unique(np.concatenate(met), return_index=True)
        sims, who, ids = np.concatenate(sims)[at], met >> 32, keys[met & 0xFFFFFFFF]
        lens = np.bincount(who, minlength=len(keys))
        some = np.flatnonzero(lens)
        rows = []
        for to, at, mine in _dealt_lists(keys[some], lens[some], parts):
            rows.append(_row(part=to, m=m, keys=keys[some[at]], homes=None, small=None, lens=lens[some[at]].astype("u2"), ids=ids[mine], sims=sims[mine], entries=0, gained=0))
        return _table(rows, _LISTS)

    wanted = graph.select("part", "m", "keys", "homes", "lens", "ids").mapInArrow(asks, _ddl(_ASKS)).repartitionById(parts, "part").mapInArrow(wants, _ddl(_WANTS))
    sent = wanted.unionByName(graph.select("part", "m", "keys", "small", "lens", "ids", "sims").mapInArrow(bodies, _ddl(_WANTS))).repartitionById(parts, "part").mapInArrow(parcels, _ddl(_PARCELS))
    return sent.groupBy("m", "grp").applyInArrow(inside, _ddl(_LISTS))


def classes(base: DataFrame) -> DataFrame:
    """(m, vec, key, last): one row a class of equal unit vectors, with its smallest and largest key. Hot classes meet on the map side."""
    return base.groupBy("m", "vec").agg(F.min("key").alias("key"), F.max("key").alias("last"))


def build_graph(vectors: DataFrame, contracts: DataFrame, k: int = K, rounds: int = ROUNDS, introduced: int = INTRODUCED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, classes, base): for each class the nearest others, the classes, and all valid rows (not staged: few of them are ever needed again).

    graph: m, key, nbrs, sims, one row a class, nearest first, HELD or k entries. Rounds are cut by tables written to the shared
    folder, of which each is deleted once the next stands. ``rounds=0`` leaves the lists of the blocks they start with. Cosines are
    those of 8-bit integers, see COARSE.
    """
    held = max(k, HELD)
    base = unit_vectors(vectors, contracts)
    reps = staged(classes(base), "classes")
    parts = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-reps.count() // PART))
    first, placed = _first_lists(reps, held, parts)
    old = staged(_merged(first, held, parts), "graph")
    _drop(placed)
    for r in range(rounds):
        fresh = staged(_introductions(old, r, parts, held, introduced), "fresh")
        graph = staged(_merged(old.unionByName(fresh), held, parts), "graph")
        _drop(old), _drop(fresh)
        old = graph
        renewed, entries = old.select(F.sum("gained"), F.sum("entries")).first()
        if (renewed or 0) <= SETTLED * (entries or 0):
            break

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, lens = _number(r["keys"], "i8"), _lens(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), r["m"], "i4")), pa.array(keys), _lists(_number(r["ids"], "i8"), lens, pa.int64()), _lists(_number(r["sims"], "f4"), lens, pa.float32())], ["m", "key", "nbrs", "sims"])

    return old.select("m", "keys", "lens", "ids", "sims").mapInArrow(opened, "m int, key bigint, nbrs array<bigint>, sims array<float>"), reps, base


def _drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def _members(reps: DataFrame, base: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(all rows of classes with several, (rep, member)), and for each such class its k + 1 smallest keys."""
    several = reps.where("last <> key").select("m", "vec", F.col("key").alias("rep"))
    rows = staged(base.join(several, ["m", "vec"]).select("rep", F.col("key").alias("member")).distinct(), "members")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("_r") <= k + 1).drop("_r")
    return rows, staged(first, "members")


def edges_of(graph: DataFrame, k: int) -> DataFrame:
    """(rep, to, cos): the first k entries of each list."""
    return graph.select(F.col("key").alias("rep"), F.explode(F.arrays_zip(F.slice("nbrs", 1, k).alias("nbrs"), F.slice("sims", 1, k).alias("sims"))).alias("e")).select("rep", F.col("e.nbrs").alias("to"), F.col("e.sims").cast("double").alias("cos"))


def _scored(pairs: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs with their vectors ``x`` and ``y`` of 16-bit floats."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(np.frombuffer(batch.column("x").buffers()[1], "i4")[batch.column("x").offset :][: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, int)
            for w in np.unique(widths):
                own = batch.filter(pa.array(widths == w))
                cos = np.einsum("ij,ij->i", _matrix(own.column("x")), _matrix(own.column("y")))
                yield pa.RecordBatch.from_arrays([own.column("a"), own.column("b"), pa.array(cos.astype("f4"))], ["a", "b", "cos"])

    return pairs.select("a", "b", "x", "y").mapInArrow(score, "a bigint, b bigint, cos float")


def rescored(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """``edges`` with the cosines of the 16-bit vectors."""
    pairs = edges.select(F.col("rep").alias("a"), F.col("to").alias("b")).join(reps.select(F.col("key").alias("a"), F.col("vec").alias("x")), "a").join(reps.select(F.col("key").alias("b"), F.col("vec").alias("y")), "b")
    return _scored(pairs).select(F.col("a").alias("rep"), F.col("b").alias("to"), F.col("cos").cast("double").alias("cos"))


def expand(edges: DataFrame, reps: DataFrame, base: DataFrame, k: int = K, members: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, nbr, cos, rank): the k nearest rows of every row by the edges (rep, to, cos) of classes, members of its own class first, ties by key.

    Of a class only the k + 1 smallest keys can be among anybody's nearest, so a class of any size adds k rows a member.
    """
    rows, first = members or _members(reps, base, k)
    targets = edges.join(first.select(F.col("rep").alias("to"), F.col("member").alias("_n")), "to", "left").select("rep", F.coalesce("_n", "to").alias("nbr"), "cos")
    outward = targets.join(rows, "rep", "left").select(F.coalesce("member", "rep").alias("key"), "nbr", "cos")
    inward = rows.join(first.select("rep", F.col("member").alias("nbr")), "rep").where("member <> nbr").select(F.col("member").alias("key"), "nbr", F.lit(1.0).alias("cos"))
    order = Window.partitionBy("key").orderBy(F.desc("cos"), "nbr")
    return outward.unionByName(inward).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, contracts: DataFrame, least: float = 0.9, k: int = K) -> DataFrame:
    """(key_a, key_b, cos), key_a < key_b: rows of one model with a cosine of at least ``least`` of which one is among the k nearest of the other.

    Cosines within DOUBT of ``least`` are computed again in double precision from the given vectors. Rows that are
    not valid (see unit_vectors) take no part; repeated rows count once; an empty table gives an empty one.
    """
    graph, reps, base = build_graph(vectors, contracts, k)
    graph = graph.where(F.get("sims", F.lit(0)) >= least - COARSE)  # the nearest is first
    close = rescored(edges_of(graph, max(k, HELD)).where(F.col("cos") >= least - COARSE), reps).where(F.col("cos") >= least - DOUBT)
    found = expand(close, reps, base, k).select(F.least("key", "nbr").alias("key_a"), F.greatest("key", "nbr").alias("key_b"), "cos").groupBy("key_a", "key_b").agg(F.max("cos").alias("cos"))
    found = staged(found, "pairs")
    near = F.abs(F.col("cos") - least) <= DOUBT
    given = vectors.where("vector IS NOT NULL").select(F.shiftleft(F.col("file_id").cast("long"), 16).bitwiseOR(F.col("frame_idx").cast("long")).alias("_k"), "vector")
    doubtful = found.where(near).select("key_a", "key_b")
    wanted = doubtful.select(F.explode(F.array("key_a", "key_b")).alias("_k")).distinct()
    given = given.join(wanted, "_k", "left_semi").groupBy("_k").agg(F.max("vector").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    again = doubtful.join(given.select(F.col("_k").alias("key_a"), F.col("v").alias("va")), "key_a").join(given.select(F.col("_k").alias("key_b"), F.col("v").alias("vb")), "key_b")
    again = again.select("key_a", "key_b", (dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va"))) / F.sqrt(dot(F.col("vb"), F.col("vb")))).alias("cos"))
    return found.where(~near).unionByName(again).where(F.col("cos") >= least)


def nearest(vectors: DataFrame, contracts: DataFrame, k: int = K) -> DataFrame:
    """(key, nbrs, cosines): the k nearest rows of each valid row, nearest first, ties by key."""
    graph, reps, base = build_graph(vectors, contracts, k)
    flat = expand(edges_of(graph, k), reps, base, k)
    lists = F.array_sort(F.collect_list(F.struct("rank", "nbr", "cos")))
    return flat.groupBy("key").agg(lists.alias("l")).select("key", F.col("l.nbr").alias("nbrs"), F.col("l.cos").alias("cosines"))


def search(graph: DataFrame, reps: DataFrame, queries: DataFrame, k: int = K, beam: int = 96, fan: int = 24, steps: int = 8) -> DataFrame:
    """(query, nbr, cos, rank): greedy search of the graph for each query (``m``, ``query``, ``vec``).

    A query starts at the nodes nearest to some pivots, and in each step opens the ``fan`` best nodes of its beam that are not
    open yet; all they point to, and all that points to them among their reverse links, is compared. It ends after
    ``steps`` or when no query finds anything better. A node equal to a query's own id is left out of its answer.
    """
    links = graph.select("key", F.explode("nbrs").alias("to"))
    back = links.select(F.col("to").alias("key"), F.col("key").alias("to")).withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("to")))).where(F.col("_r") <= 2 * k).drop("_r")
    links = staged(links.unionByName(back).distinct(), "links")
    entries = reps.withColumn("_r", F.row_number().over(Window.partitionBy("m", F.pmod(F.xxhash64("key"), F.lit(beam))).orderBy(F.xxhash64("key")))).where(F.col("_r") == 1).select("m", F.col("key").alias("to"))
    queries = staged(queries.select("m", "query", "vec"), "queries")
    fresh = queries.select("m", "query").join(entries, "m").select("query", "to").unionByName(queries.join(reps.select("key"), F.col("query") == F.col("key")).select("query", F.col("query").alias("to")))
    state: DataFrame | None = None
    nodes = reps.select(F.col("key").alias("to"), F.col("vec").alias("x"))

    for step in range(steps):
        scored = fresh.distinct().join(nodes, "to").join(queries.select("query", "vec"), "query").select(F.col("query").alias("a"), F.col("to").alias("b"), "x", F.col("vec").alias("y"))
        scored = _scored(scored).select(F.col("a").alias("query"), F.col("b").alias("to"), "cos", F.lit(0).alias("open"))
        pool = scored if state is None else state.unionByName(scored)
        pool = pool.groupBy("query", "to").agg(F.max("cos").alias("cos"), F.max("open").alias("open"))
        ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "to"))).where(F.col("rank") <= beam)
        ranked = ranked.withColumn("turn", F.sum(F.lit(1) - F.col("open")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
        ranked = ranked.withColumn("now", (F.col("open") == 0) & (F.col("turn") <= fan))
        last, state = state, staged(ranked.select("query", "to", "cos", (F.col("open").cast("boolean") | F.col("now")).cast("int").alias("open"), "now", "rank"), "beam")
        if last is not None:
            _drop(last)
        front = state.where("now").select("query", F.col("to").alias("key"))
        state = state.drop("now")
        if step == steps - 1 or front.isEmpty():
            break
        state = state.drop("rank")
        fresh = front.join(links, "key").select("query", "to")
    answer = state.where("query <> to")
    return answer.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cos"), "to"))).where(F.col("rank") <= k).select("query", F.col("to").alias("nbr"), F.col("cos").cast("double").alias("cos"), "rank")


def search_rows(graph: DataFrame, reps: DataFrame, base: DataFrame, wanted: Callable[[str], Column], k: int = K) -> DataFrame:
    """(query, nbr, cos, rank): the answer of ``search`` for every valid row whose key is ``wanted`` (a condition on the column named).

    Classes are searched once; rows of one class share its answer, in which each class found stands with its members,
    and have the members of their own class first, as in ``expand``.
    """
    rows, first = _members(reps, base, k)
    rows = rows.where(wanted("member"))
    asked = reps.where(wanted("key")).select("key").unionByName(rows.select(F.col("rep").alias("key"))).distinct()
    found = search(graph, reps, reps.join(asked, "key").select("m", F.col("key").alias("query"), "vec"), k)
    return expand(found.select(F.col("query").alias("rep"), F.col("nbr").alias("to"), "cos"), reps, base, k, (rows, first)).where(wanted("key")).select(F.col("key").alias("query"), "nbr", "cos", "rank")
