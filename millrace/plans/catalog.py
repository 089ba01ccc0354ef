"""The queries of the library's own operators and the SQL that has the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, corpus, governance, health, relational, reports, structure, tasks

_ALL = corpus.QUERIES | analysis.QUERIES | relational.QUERIES | tasks.QUERIES | structure.QUERIES | governance.QUERIES | reports.QUERIES | health.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
