"""Queries of this subpackage, each with its SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from weftline.plans.registry import Query, Run

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = Query(run.__name__, run, sql)
        return run

    return add
