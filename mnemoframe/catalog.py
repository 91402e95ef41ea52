"""A named collection of queries, each with an optional SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Maps a query's name to a callable ``(spark, data_dir) -> DataFrame`` and to its SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Register the decorated callable as ``name``; ``sql`` is what DuckDB runs beside it."""

        def register(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register

    def include(self, other: Catalog) -> None:
        for name, fn in other.queries.items():
            self.query(name, other.sql.get(name))(fn)
