"""Registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, base, extended, relational, series, technical  # noqa: F401 - they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return technical.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
