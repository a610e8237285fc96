"""Registered queries: name to Spark query, and to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logstream.plans import fixture

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``check`` is the body of its oracle SQL."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if check is not None:
            ORACLES[run.__name__] = fixture.oracle(check)
        return run

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from logstream.plans import derived, lookups, models, records, statistics, storage  # noqa: F401
