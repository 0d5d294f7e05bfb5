"""The scheduler: rounds of releasing, claiming and working, each committed before the next step begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators import tasks
from tidemark.sources.warehouse import Warehouse


def round_once(house: Warehouse, work: Callable[[DataFrame], DataFrame], now_ms: int, limit: int = 1000) -> int:
    """One round; gives the number of tasks claimed.

    Claims are committed before ``work`` sees them, and what it gives back (task_id, event) is committed after it. If it dies
    between, the tasks are in flight and come back by ``tasks.recover``. Tasks that it says nothing of give their claim back.
    """
    after, _ = tasks.tick(house.read("tasks"), now_ms, limit)
    before = house.read("tasks").where("state = 'in_flight'").select("task_id")
    at = house.commit({"tasks": after})
    claimed = house.read("tasks", at).where("state = 'in_flight'").join(before, "task_id", "left_anti")
    n = claimed.count()
    if n:
        said = work(claimed).select("task_id", "event").join(claimed.select("task_id"), "task_id", "left_semi")
        silent = claimed.select("task_id").join(said.select("task_id"), "task_id", "left_anti").selectExpr("task_id", "'refund' AS event")
        house.commit({"tasks": tasks.settle(house.read("tasks", at), said.unionByName(silent), now_ms)})
    return n


def run(house: Warehouse, work: Callable[[DataFrame], DataFrame], clock: Callable[[], int], wait: Callable[[], bool], limit: int = 1000) -> int:
    """Rounds until ``wait``, called when a round found nothing to do, says False; gives the number of tasks claimed in all. The warehouse is owned meanwhile."""
    total = 0
    with house.owner():
        while True:
            n = round_once(house, work, clock(), limit)
            total += n
            if not n and not wait():
                return total
