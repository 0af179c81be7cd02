"""Named queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["text_queries", "row_queries", "relational_queries", "measure_queries", "udf_queries", "io_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in MODULES:
        import_module(f"prosemill.plans.{m}")
    from prosemill.plans.catalogue import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from prosemill.plans.catalogue import SQL

    return dict(SQL)
