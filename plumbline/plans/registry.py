"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can say the same, that SQL."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from plumbline.plans import (  # noqa: F401
        check_queries,
        finding_queries,
        health_queries,
        lifecycle_queries,
        lineage_queries,
        maintenance_queries,
        metadata_queries,
        metric_queries,
        profile_queries,
        relationship_queries,
        rule_scan_queries,
        stream_queries,
    )
