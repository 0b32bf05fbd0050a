"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineweave.plans import commit_queries, diff_queries, join_queries, log_queries, report_queries, scalar_queries, stream_queries, table_queries  # noqa: F401  they register
from lineweave.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
