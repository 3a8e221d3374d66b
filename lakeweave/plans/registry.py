"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accounts, audit, details, features, governance, graph, intake, lifecycle, market, platform, relational, retrieval, safety, stateful, text, usage

FLAGSHIP = "agg_usage_daily"
_MODULES = (usage, market, audit, relational, text, retrieval, graph, governance, stateful, features, safety, platform, lifecycle, details, intake, accounts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
