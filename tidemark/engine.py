"""The engine as one object: search in three modes with degradation, maintenance, and the order of its steps."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import snippet
from tidemark.operators import catalog, keyword, reliability, search
from tidemark.operators.extract import PLAIN
from tidemark.sources.warehouse import Warehouse


class Unavailable(Exception):
    """The embedding service can't be reached."""


@dataclass
class Request:
    query: str
    mode: str = "hybrid"
    top_k: int = 20
    path_prefix: str | None = None
    kinds: tuple[str, ...] = ()
    mtime_from_ns: int | None = None
    mtime_to_ns: int | None = None

    def problems(self) -> list[str]:
        out = []
        if not self.query.strip():
            out.append("query is empty")
        if self.mode not in ("hybrid", "keyword", "semantic"):
            out.append(f"unknown mode {self.mode}")
        if not 1 <= self.top_k <= 1000:
            out.append("top_k is 1 to 1000")
        return out


@dataclass
class Response:
    """Hits, best first; whether the semantic part was left out; whether more hits may exist than were looked at, which an exact search never leaves open."""

    hits: DataFrame
    degraded_semantic: bool = False
    incomplete: bool = False

    def problems(self, r: Request) -> list[str]:
        """What is wrong with the collected hits, for a caller that trusts no back end: too many, repeated, out of order, unnamed, of no source."""
        rows = self.hits.collect()
        order = [(-h["score"], h["best_rank"], h["file_id"]) for h in rows]
        out = []
        if len(rows) > r.top_k:
            out.append("more hits than asked for")
        if len({h["file_id"] for h in rows}) < len(rows):
            out.append("a file is named twice")
        if order != sorted(order):
            out.append("hits are out of order")
        for h in rows:
            if not h["path"] or h["file_id"] < 1 or not h["score"] > 0 or h["best_rank"] < 1:
                out.append(f"hit {h['file_id']} is not valid")
            if not h["sources"] or set(h["sources"].split(",")) - set(search.SOURCES):
                out.append(f"hit {h['file_id']} has unknown sources")
        return out


def parse(args: list[str]) -> Request:
    """A request from command-line words: --mode, --limit, --path-prefix, --kind (repeatable, comma lists), --mtime-from, --mtime-to, then the query."""
    p = argparse.ArgumentParser(exit_on_error=False)
    p.add_argument("--mode", default="hybrid", choices=["hybrid", "keyword", "semantic"])
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--path-prefix")
    p.add_argument("--kind", action="append", default=[])
    p.add_argument("--mtime-from", type=int)
    p.add_argument("--mtime-to", type=int)
    p.add_argument("query", nargs="+")
    a = p.parse_args(args)
    kinds = tuple(dict.fromkeys(k.strip() for x in a.kind for k in x.split(",") if k.strip()))
    return Request(" ".join(a.query), a.mode, a.limit, a.path_prefix, kinds, a.mtime_from, a.mtime_to)


class Engine:
    """Search and maintenance over a warehouse with files, docs, vectors and dead_letters.

    ``embed`` turns a query into (model, vector) and raises Unavailable when it can't.
    """

    def __init__(self, house: Warehouse, embed: Callable[[str], tuple[str, list[float]]] | None = None, model: str | None = None) -> None:
        self.house, self.embed, self.model = house, embed, model

    def search(self, r: Request) -> Response:
        """Hits (file_id, score, best_rank, sources, path, kind, status, snippet, frame_idx, frame_ts_ms), best first.

        Filters hold before ranks are given, and both lists are ranked whole. Keywords are read from the stored index where there is one. The frame is the best one of a file that was found by its vectors. Without an embedding, or with one of another model, hybrid answers from keywords and says so.
        """
        if r.problems():
            raise ValueError("; ".join(r.problems()))
        at = self.house.manifest()  # one snapshot for all tables
        files = catalog.select(self.house.read("files", at), r.path_prefix, list(r.kinds) or None, r.mtime_from_ns, r.mtime_to_ns)
        docs = self.house.read("docs", at)
        none = files.select("file_id", F.lit(0.0).alias("score")).where(F.lit(False))
        words = [t for t in r.query.lower().split() if t]
        kw = none
        if r.mode != "semantic":
            stats = at["meta"].get("keyword")
            scored = keyword.scores(self.house.read("postings", at), {f: tuple(x) for f, x in stats.items()}, words) if stats and "postings" in at["tables"] else keyword.bm25(docs, words)
            kw = scored.join(search.eligible_keyword(files).select("file_id"), "file_id", "left_semi")
        sem, degraded = none, False
        frames = none.select("file_id", F.lit(0).alias("frame_idx"), F.lit(0).cast("long").alias("frame_ts_ms"))
        if r.mode != "keyword":
            try:
                if self.embed is None:
                    raise Unavailable
                model, vector = self.embed(r.query)
                if self.model and model != self.model:
                    raise Unavailable
                near = search.best_frames(search.vector_scores(self.house.read("vectors", at), vector, model).join(search.eligible_semantic(files, model).select("file_id"), "file_id", "left_semi"))
                sem, frames = near.select("file_id", "score"), near.select("file_id", "frame_idx", "frame_ts_ms")
            except Unavailable:
                degraded = True
        fused = search.hybrid(kw, sem, r.top_k).join(frames, "file_id", "left")
        shown = fused.join(files.select("file_id", F.col("path_key").alias("path"), "kind", "status"), "file_id").join(docs.select("file_id", "content"), "file_id", "left")
        hits = shown.select("file_id", "score", "best_rank", "sources", "path", "kind", "status", snippet(F.coalesce("content", F.lit("")), F.col("status")).alias("snippet"), "frame_idx", "frame_ts_ms")
        return Response(hits.orderBy(F.desc("score"), "best_rank", "file_id"), degraded)

    def adopt_model(self, model: str, dims: int) -> bool:
        """Makes a model the active one under its contract; False if it was, an error if its dims differ from the contract's."""
        meta = self.house.manifest()["meta"]
        contracts = meta.get("contracts", {})
        if contracts.get(model, dims) != dims:
            raise ValueError(f"{model} has {contracts[model]} dims")
        changed = meta.get("active_model") != model
        if changed:
            self.house.commit({}, {"active_model": model, "contracts": contracts | {model: dims}})
        self.model = model
        return changed

    def maintain(self, now_ms: int) -> dict[str, DataFrame]:
        """What a maintenance run would do, in its order: version redrive, model upgrade, projections of failed files, expired dead letters."""
        at = self.house.manifest()
        files, dead = self.house.read("files", at), self.house.read("dead_letters", at)
        mismatch = reliability.version_mismatch(dead, PLAIN.version, self.model)
        out = {"redrive": mismatch}
        if self.model:
            out["upgrade"] = reliability.model_upgrade_batch(files, self.model)
        return out | {"projections": reliability.failed_projection(dead, files), "expired": reliability.expired(dead, now_ms)}


def format_hit(row) -> str:
    """One line for a hit."""
    return f"{row['score']:.6f}\t{row['sources']}\t{row['kind']}\t{row['path']}"
