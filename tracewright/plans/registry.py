"""Names, callables and oracle SQL of the reporting queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with oracle SQL where there is some."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLE)


def load() -> None:
    """Import the modules that register queries."""
    from tracewright.plans import attribution_queries, children_queries, codex_queries, compliance_queries, friction_queries, knowledge_queries, lens_queries, message_queries, meter_queries, pricing_queries, report_queries, rollup_queries, run_queries, source_queries, transcript_queries  # noqa: F401


def names() -> list[str]:
    load()
    return list(_QUERIES)
