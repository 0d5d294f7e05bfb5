"""Processing only new or changed records: a work-item ledger.

A work item is one state of a record (its key and version columns). Attempts lease items under a fencing token, a number that only
grows, and end in one of the fates below. The ledger is the fold of both: an item is done when a token that leased it is done,
leased while such a token is open and its lease runs, and pending otherwise, so that leases that ran out and
attempts that failed give their items back. ``ledger`` is that fold, for the history in a table (``replay``) and for the store
on disk (``begin``, ``publish``, ``run_once``) alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folder import Folder

TOKENS = "token bigint, owner string, fate string, lease_until bigint"
#: Fates of a token: its results count, it works, it gave its items back.
DONE, OPEN, RELEASED = "done", "open", "released"


def current_rows(rows: DataFrame, key: str = "file_id", version: str = "generation", keep: list[str] | None = None) -> DataFrame:
    """The row of the highest version of each key.

    Partial aggregation before the shuffle, so repeated rows and old generations of a hot key meet
    on the map side. Rows with a null key or version are left out. Equal versions: the largest of
    the kept columns wins, in their order. An empty table gives an empty one.
    """
    keep = [c for c in (keep or rows.columns) if c not in (key, version)]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in keep])).alias("_best")
    return rows.where(F.col(key).isNotNull() & F.col(version).isNotNull()).groupBy(key).agg(best).select(key, F.col(f"_best.{version}").alias(version), *[F.col(f"_best.{c}").alias(c) for c in keep])


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join of items in which null versions are equal; of the right side the columns beside ``on`` are added."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    joined = left.join(named, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], how)
    return joined.drop(*[f"_r_{c}" for c in on])


def ledger(items: DataFrame, leases: DataFrame, tokens: DataFrame, on: list[str], now_us: Column | int) -> DataFrame:
    """Each item with ``state`` (pending, leased, done), ``token``, ``owner`` and ``lease_until``.

    items: one row an item, with the columns ``on``. leases: ``on`` and ``token``, for every item that a token took. tokens: see TOKENS.
    ``token`` is the newest that touched the item, 0 if none did; ``owner`` and ``lease_until`` are those of the lease that runs. Nulls in
    ``on`` are equal; repeated leases count once; a token that ``tokens`` doesn't know has given its items back; extra columns are dropped.
    """
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    alive = (F.col("fate") == OPEN) & (F.col("lease_until") > now)
    fate = tokens.select("token", (F.col("fate") == DONE).alias("_won"), F.when(alive, F.struct("lease_until", "owner")).alias("_held"))
    touched = (
        leases.select(*on, "token")
        .join(fate, "token", "left")
        .groupBy(*on)
        .agg(F.max(F.coalesce("_won", F.lit(False))).alias("_won"), F.max("token").alias("_token"), F.max("_held").alias("_held"))
    )
    state = F.when(F.col("_won"), "done").when(F.col("_held").isNotNull(), "leased").otherwise("pending")
    held = lambda c, kind: F.when(state == "leased", F.col(f"_held.{c}")).cast(kind).alias(c)
    return meet(items.select(*on), touched, on, "left").select(*on, state.alias("state"), F.coalesce("_token", F.lit(0)).cast("long").alias("token"), held("owner", "string"), held("lease_until", "long"))


def replay(items: DataFrame, writes: DataFrame, attempts: DataFrame, on: list[str], now: Column, ttl_us: int = 3_600_000_000) -> DataFrame:
    """The ledger after a history of attempts, which is read as a history of leases.

    writes: what attempts took in hand (``run_id``, ``attempt`` and ``on``). attempts: ``run_id``, ``attempt``, ``state``, ``started_at``.

    The token of an attempt is ``run_id << 20 | attempt``. One that succeeded has published, so its items are done; one that runs holds a
    lease of ``ttl_us`` from its start; one that failed, was aborted or is unknown has given its items back. Of rows
    that give one attempt several states ``succeeded`` stands, then ``running``.
    """
    number = (F.shiftleft(F.col("run_id").cast("long"), 20) + F.col("attempt")).alias("token")
    won, since = F.max(F.col("state") == "succeeded"), F.max(F.when(F.col("state") == "running", F.unix_micros(F.col("started_at").cast("timestamp"))))
    tokens = attempts.where("run_id IS NOT NULL AND attempt IS NOT NULL").groupBy(number).agg(F.when(won, DONE).when(since.isNotNull(), OPEN).otherwise(RELEASED).alias("fate"), (since + ttl_us).alias("lease_until"))
    return ledger(items, writes.select(*on, number), tokens.withColumn("owner", F.lit(None).cast("string")), on, F.unix_micros(now.cast("timestamp")))


class Busy(Exception):
    """Others got ahead each time."""


class Stale(Exception):
    """The lease ran out and its items were given to a newer token."""


@dataclass
class Entry:
    """One entry of a store's log: what a token did. A lease names the tokens that it found run out, which can't publish any more."""

    kind: str
    token: int
    owner: str = ""
    lease_until: int = 0
    path: str = ""
    expired: tuple[int, ...] = ()


class Store:
    """A ledger on a file system: ``log/<n>.json``, each created once, ``leases/...`` and ``out/token=<n>``.

    The number of a lease's entry is its token. An entry is published by creating the next file of the log, which only one writer can; who
    loses reads what has come in between and decides again. Every run writes the items it leased, not the whole ledger; the log grows by
    two small files a run.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, Folder(spark, folder)

    def log(self) -> list[Entry]:
        """All entries, in order."""
        names = [n for n in self.folder.names("log") if n.endswith(".json")]
        return [Entry(**(raw | {"expired": tuple(raw.get("expired", ()))})) for raw in (json.loads(self.folder.read(f"log/{n}")) for n in names)]

    def append(self, at: int, entry: Entry) -> bool:
        """Publishes entry number ``at``; False if another has taken that number."""
        return self.folder.create(f"log/{at:020d}.json", json.dumps(entry.__dict__))

    def tokens(self, log: list[Entry]) -> dict[int, tuple[str, str, int]]:
        """Owner, fate and end of lease of each token."""
        out: dict[int, tuple[str, str, int]] = {}
        for e in log:
            if e.kind == "lease":
                out[e.token] = (e.owner, OPEN, e.lease_until)
                for t in e.expired:
                    out[t] = (out[t][0], RELEASED, out[t][2])
            else:
                out[e.token] = (out[e.token][0], e.kind, out[e.token][2])
        return out

    def book(self, items: DataFrame, on: list[str], log: list[Entry], now_us: int) -> DataFrame:
        """The ledger of items after a log."""
        tokens = self.spark.createDataFrame([(t, o, f, u) for t, (o, f, u) in self.tokens(log).items()], TOKENS)
        paths = [self.folder.under(e.path) for e in log if e.kind == "lease"]
        kinds = [F.col(c).cast(items.schema[c].dataType).alias(c) for c in on]
        leases = self.spark.read.parquet(*paths).select(*kinds, "token") if paths else items.select(*on, F.lit(0).cast("long").alias("token")).where(F.lit(False))
        return ledger(items, leases, tokens, on, now_us)


def begin(items: DataFrame, on: list[str], store: Store, now_us: int, ttl_us: int = 3_600_000_000, owner: str = "run", tries: int = 20) -> int:
    """Leases all pending items, published before any work; gives the token.

    Two that begin at once can't get the same items: the log takes one lease, and the other reads it and takes what is left. Leases that
    ran out by ``now_us`` are ended by the same entry, so that their holders can't publish later.
    """
    for _ in range(tries):
        log = store.log()
        token = len(log) + 1
        path = f"leases/token={token}-{owner}"
        run_out = tuple(t for t, (_, fate, until) in store.tokens(log).items() if fate == OPEN and until <= now_us)
        book = store.book(items.select(*on).distinct(), on, log, now_us)
        book.where("state = 'pending'").select(*on, F.lit(token).cast("long").alias("token")).write.mode("overwrite").parquet(store.folder.under(path))
        if store.append(token, Entry("lease", token, owner, now_us + ttl_us, path, run_out)):
            return token
    raise Busy(store.folder.path)


def leased(items: DataFrame, on: list[str], store: Store, token: int) -> DataFrame:
    """The rows of ``items`` that a token leased."""
    path = next(e.path for e in store.log() if e.kind == "lease" and e.token == token)
    return meet(items, store.spark.read.parquet(store.folder.under(path)).select(*on), on, "left_semi")


def publish(store: Store, token: int, fate: str = DONE, tries: int = 20) -> None:
    """Ends a token: its results at ``out/token=<n>`` count from now on, or its items go back. Stale if a newer lease has ended it before.

    The token is compared at the moment the entry is set: an entry that came in between makes this one decide again. Ending a token
    twice in the same way is no error and changes nothing.
    """
    for _ in range(tries):
        log = store.log()
        now = store.tokens(log)[token][1]
        if now == fate:
            return
        if now != OPEN:
            raise Stale(f"token {token} is {now}")
        if store.append(len(log) + 1, Entry(fate, token, path=f"out/token={token}")):
            return
    raise Busy(store.folder.path)


def run_once(items: DataFrame, on: list[str], process: Callable[[DataFrame], DataFrame], store: str, now_us: int, ttl_us: int = 3_600_000_000, owner: str = "run") -> int:
    """One run over the items that no run has done and none holds; gives the run's token.

    Outputs go to ``out/token=<n>``, a path fixed before work begins and overwritten by a retry, and count only once published. A run that
    fails gives its items back; of one that dies they come back when its lease runs out. Null versions are versions like any other.
    """
    book = Store(items.sparkSession, store)
    token = begin(items, on, book, now_us, ttl_us, owner)
    try:
        process(leased(items, on, book, token)).write.mode("overwrite").parquet(book.folder.under(f"out/token={token}"))
    except Exception:
        publish(book, token, RELEASED)
        raise
    publish(book, token)
    return token


def finished(spark: SparkSession, store: str) -> DataFrame | None:
    """All published outputs of a store, or None before the first."""
    book = Store(spark, store)
    outs = [book.folder.under(e.path) for e in book.log() if e.kind == DONE]
    return spark.read.parquet(*outs) if outs else None
