"""Operators for large-scale training-data pipelines (problems 1 to 9).

Nothing outside this subpackage imports it. `queries()` and `oracle_sql()` collect what the
modules register.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from siltmark.llm import catalogue

    return catalogue.QUERIES


def oracle_sql() -> dict[str, str]:
    from siltmark.llm import catalogue

    return catalogue.ORACLE_SQL
