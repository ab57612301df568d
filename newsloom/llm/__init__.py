"""Operators for preparing training text, and the queries that apply them.

``REGISTRY`` maps a query's name to (callable of (spark, folder), SQL text or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        REGISTRY[name] = (build, sql)
        return build

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    from newsloom.llm import queries  # noqa: F401

    return REGISTRY
