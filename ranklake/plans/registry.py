"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("movement", "formats", "relations", "summaries", "samples", "scalars", "corpus", "pages", "retrieval", "estimators", "effects", "vectors", "judging", "panels", "drivers", "upkeep")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for use in another's."""
    return _SQL[name]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much, and how often, re-ranking moves items, overall and for each cell."""
    _load()
    return _QUERIES["a10_movement"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
