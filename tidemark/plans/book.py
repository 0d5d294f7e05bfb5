"""A book of named queries: each has a function of the views and, where SQL can say it, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.views import duck, view

Views = Callable[[str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        """``run`` gets a function that gives a view by name; ``{view}`` in ``sql`` stands for the same view."""
        self.queries[name] = lambda spark, d: run(lambda n: view(spark, d, n))
        if sql:
            self.sql[name] = duck(sql)
