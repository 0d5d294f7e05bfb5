"""A circuit breaker for dependencies: the live object, and its states over a log of outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Breaker:
    """closed, open after ``threshold`` failures in a row, half_open for one probe once ``open_ms`` have passed."""

    threshold: int = 5
    open_ms: int = 30_000
    state: str = "closed"
    failures: int = 0
    opened_ms: int = 0
    epoch: int = 0
    probing: bool = False

    def allow(self, now_ms: int) -> int | None:
        """The epoch a call may run under; None when it is refused."""
        if self.state == "open" and now_ms - self.opened_ms >= self.open_ms:
            self.state, self.probing = "half_open", False
            self.epoch += 1
        if self.state == "open" or (self.state == "half_open" and self.probing):
            return None
        self.probing = self.state == "half_open"
        return self.epoch

    def done(self, epoch: int, ok: bool, now_ms: int) -> None:
        """The outcome of a call; one that began before the last change of state counts for nothing."""
        if epoch != self.epoch:
            return
        if ok:
            if self.state == "half_open":
                self.epoch += 1
            self.state, self.failures, self.probing = "closed", 0, False
            return
        self.failures += 1
        if self.state == "half_open" or self.failures >= self.threshold:
            self.state, self.opened_ms, self.probing, self.failures = "open", now_ms, False, 0
            self.epoch += 1


def history(outcomes: DataFrame, threshold: int = 5, open_ms: int = 30_000) -> DataFrame:
    """(dependency, seq, verdict, state) of a log (dependency, seq, at_ms, ok): refused, ok or failed, and the state after it.

    A breaker is sequential, so each dependency is read in order by one task, streaming: memory holds one breaker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, b = None, Breaker(threshold, open_ms)
        for batch in batches:
            out = []
            for dep, seq, at, ok in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if dep != name:
                    name, b = dep, Breaker(threshold, open_ms)
                epoch = b.allow(at)
                if epoch is not None:
                    b.done(epoch, bool(ok), at)
                out.append((dep, seq, "refused" if epoch is None else "ok" if ok else "failed", b.state))
            d, s, v, st = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, batch.schema[0].type), pa.array(s, pa.int64()), pa.array(v, pa.string()), pa.array(st, pa.string())], ["dependency", "seq", "verdict", "state"])

    rows = outcomes.select("dependency", "seq", "at_ms", "ok").repartition("dependency").sortWithinPartitions("dependency", "seq")
    kind = rows.schema["dependency"].dataType.simpleString()
    return rows.mapInArrow(run, f"dependency {kind}, seq bigint, verdict string, state string")


#: Class of a dependency's failure by RPC status (fixed values); other statuses are failures of the request.
UNAVAILABLE = ["UNAVAILABLE", "DEADLINE_EXCEEDED", "RESOURCE_EXHAUSTED", "ABORTED"]
