"""All registered queries of the mobility library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowatlas.plans import files, mobility, operations, places
from flowatlas.plans.fixtures import with_ctes

MODULES = (mobility, places, operations, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes("duckdb", sql) for m in MODULES for name, sql in m.SQL.items()}
