"""The subpackage's queries by name, and SQL for those that SQL can express.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.workspace import modest_batches

Query = Callable[[SparkSession, str], DataFrame]

MODULES = tuple(f"op{n}" for n in range(1, 14))


def _loaded() -> list:
    return [import_module(f"{__package__}.queries.{name}") for name in MODULES]


def _modest(query: Query) -> Query:
    """The query in a session whose Arrow batches suit long texts."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        modest_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {m.NAME: _modest(m.query) for m in _loaded()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _loaded() if m.SQL}
