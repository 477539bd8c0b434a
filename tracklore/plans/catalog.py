"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bout_queries, report_queries, series_queries, shape_queries, table_queries

_ALL = {**bout_queries.QUERIES, **series_queries.QUERIES, **table_queries.QUERIES, **report_queries.QUERIES, **shape_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
