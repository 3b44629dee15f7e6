"""The queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_EXAMPLES: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("overlap", "corpus", "literature", "evidence", "usage", "synthesis", "moderators", "ledger_tables", "audits", "ledgers", "scalars", "inputs", "paged", "spans", "states", "controlled", "manuscript", "worked")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL of its result."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def example(sql: str | None = None) -> Callable[[Query], Query]:
    """Keeps a worked example over a few rows of its own, for the tests; it reads no table, so it is no registered query."""

    def add(f: Query) -> Query:
        _EXAMPLES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tessella.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["overlap_verdict"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def examples() -> dict[str, tuple[Query, str | None]]:
    _load()
    return dict(_EXAMPLES)
