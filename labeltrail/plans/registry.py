"""Registry of queries: a DataFrame builder plus the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from labeltrail.plans.tables import Tables, oracle

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register `build(tables)` under a name, with its oracle statement if SQL can say it."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in BUILDERS:
            raise ValueError(f"duplicate query {name}")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = oracle(sql, views)
        return build

    return add
