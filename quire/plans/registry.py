"""All queries of the library by name, with the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import billing, catalogue, containers, errors, operations, reading, sheets, texts, timelines

MODULES = (errors, catalogue, operations, sheets, reading, containers, texts, billing, timelines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
