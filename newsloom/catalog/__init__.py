"""Named queries over the given tables, each with the SQL it must agree with.

``REGISTRY`` maps a name to (callable of (spark, folder), SQL text or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL counterpart."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        REGISTRY[name] = (run, sql)
        return build

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    from newsloom.catalog import (  # noqa: F401
        admission,
        aggregates,
        filters,
        joins,
        scalars,
        search,
        sources,
        tables,
    )

    return REGISTRY
