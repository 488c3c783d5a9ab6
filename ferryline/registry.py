"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ferryline import plans  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from ferryline import plans  # noqa: F401

    return dict(_ORACLES)
