"""Named queries: a Spark function and, where SQL can express it, the DuckDB SQL with the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("meridia.plans.q_geometry", "meridia.plans.q_split", "meridia.plans.q_text", "meridia.plans.q_rank", "meridia.plans.q_learn", "meridia.plans.q_raster", "meridia.plans.q_more", "meridia.plans.q_rest", "meridia.plans.q_runs", "meridia.plans.q_checks")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a new name; a name that is taken is an error."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name!r} is registered already")
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = oracle
        return f

    return add


def oracles() -> dict[str, str]:
    """Of the queries that are registered so far."""
    return dict(_oracles)


def load() -> None:
    for module in MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_oracles)
