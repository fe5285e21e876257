"""The queries that the driver runs, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with the SQL that must give the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from . import crawl_queries, discovery_queries, search_queries, source_queries  # noqa: F401
