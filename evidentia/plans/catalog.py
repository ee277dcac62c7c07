"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with SQL over the given and derived tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


from evidentia.plans import aggregates, assurance_queries, benchmark_queries, claim_queries, expressions, fault_queries, graph_queries, job_queries, join_queries, mapping_queries, policy_queries, rankings, review_queries, source_queries, stream_queries, vulnerability_queries, workflow_queries  # noqa: E402,F401
