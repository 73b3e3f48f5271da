"""Every registered query of the library, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import judged_sql, oracles
from .plans.judged import QUERIES
from .session import prepare


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | judged_sql.SQL
