"""Registry of the queries: a function over :class:`Tables` and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_ctes
from .tables import Tables, tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def _load() -> None:
    from . import queries_columns, queries_files, queries_jobs, queries_relational  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, fn=fn: fn(tables(spark, sf_dir))) for n, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_ctes(sql) for n, sql in ORACLES.items()}
