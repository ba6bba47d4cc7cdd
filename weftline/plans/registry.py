"""The list of runnable queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name, with its ANSI SQL equivalent."""

    def add(run: Run) -> Run:
        if run.__name__ in QUERIES:
            raise ValueError(f"{run.__name__} is registered twice")
        QUERIES[run.__name__] = Query(run.__name__, run, sql)
        return run

    return add
