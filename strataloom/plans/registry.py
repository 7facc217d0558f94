"""All queries over the data tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import context_queries, core_p3, graph_queries, history_queries, lifecycle_queries, text_queries

FLAGSHIP = "hybrid_search_rrf"
_MODULES = (graph_queries, history_queries, text_queries, context_queries, lifecycle_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"p3_found": core_p3.p3_found}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {"p3_found": core_p3.P3_SQL}
    for module in _MODULES:
        out |= module.SQL
    return out
