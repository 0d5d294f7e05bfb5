"""Debouncing as a stream: state keyed by watch root, since moves tie paths of one root together."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.debounce import WINDOW_US, Pending

OUT = "root string, op string, path string, old_path string, at_us bigint, due_us bigint"
#: An event with this op makes everything of its root due: the fence at the end of a stream or before a removal.
FLUSH = "flush"


#: The op of an action that says events of the root were lost, so that it must be scanned again.
DIRTY = "dirty"


def debounced(changes: DataFrame, window: int = WINDOW_US, most: int = 100_000) -> DataFrame:
    """Actions of a stream of changes (root, op, path_key, old_key, at_us, seq).

    Within a micro-batch, events of a root are taken in the order (at_us, seq); an action leaves once an event of its root, or
    the processing-time alarm, shows that its deadline has passed. State holds pending changes only, so a quiet root costs nothing.
    A root has ``most`` pending paths at most: what comes beyond them is dropped, and one DIRTY action a micro-batch says so; a
    source's own overflow comes in as an event with op DIRTY.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        root = key[0]
        pending = Pending(window, {p: tuple(v) for p, v in json.loads(state.get[0]).items()} if state.exists else {})
        out: list[tuple] = []
        lost = None
        if state.hasTimedOut:
            out += pending.due(None)
        else:
            rows = pd.concat(list(frames))
            # pandas makes a float of a column of longs with nulls, and NaN of a null string
            rows = rows.sort_values(["at_us", "seq"], kind="stable")
            for op, path, old, at in zip(rows["op"], rows["path_key"], rows["old_key"], rows["at_us"], strict=True):
                if op == FLUSH:
                    out += pending.due(None)
                    continue
                out += pending.due(int(at))
                if op == DIRTY or len(pending.by_path) >= most and path not in pending.by_path:
                    lost = int(at)
                    continue
                pending.add(op, path, old if isinstance(old, str) else None, int(at))
        if lost is not None:
            out.append((DIRTY, root, None, lost))
        if pending.by_path:
            state.update((json.dumps(pending.by_path),))
            state.setTimeoutDuration(max(1, window // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(root, op, p, old, at, at + window) for op, p, old, at in out], columns=["root", "op", "path", "old_path", "at_us", "due_us"])

    good = changes.where(f"root IS NOT NULL AND at_us IS NOT NULL AND (op IN ('{FLUSH}', '{DIRTY}') OR path_key IS NOT NULL AND (op IN ('created', 'modified', 'removed') OR op = 'move' AND old_key IS NOT NULL))")
    return good.groupBy("root").applyInPandasWithState(step, OUT, "pending string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def read_changes(spark, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of change files (JSON lines) dropped into a folder, cleaned as the batch view is."""
    from tidemark.functions.paths import clean_path

    raw = spark.readStream.schema("root string, op string, path string, old_path string, at_us bigint, seq bigint").option("maxFilesPerTrigger", files_a_trigger).json(folder)
    return raw.select("root", F.lower(F.trim("op")).alias("op"), clean_path("path").alias("path_key"), clean_path("old_path").alias("old_key"), "at_us", "seq")
