"""All named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import match_queries, scan_queries, source_queries, text_queries

_GROUPS = (text_queries, scan_queries, match_queries, source_queries)


def _with_settings(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(configure(spark), sf_dir)

    run.__name__ = plan.__name__
    run.__doc__ = plan.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_settings(plan) for g in _GROUPS for name, (plan, _) in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: text for g in _GROUPS for name, (_, text) in g.QUERIES.items() if text is not None
    }
