"""Named queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import duckdb_sql

FLAGSHIP = "e03_skipped_exons"
MODULES = ("annotation", "alignments", "events", "variants", "sources")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Registers a query; ``sql`` may read the fixture views and ``ctes``."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = duckdb_sql(sql, ctes)
        return f

    return add


def alias(name: str, of: str) -> None:
    """Registers a query and its SQL under one more name."""
    _QUERIES[name] = _QUERIES[of]
    if of in _SQL:
        _SQL[name] = _SQL[of]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f".queries_{m}", __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
