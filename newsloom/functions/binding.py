"""Evaluate an expression once and use it many times.

Catalyst inlines an aliased expression wherever it is used, filters included; a regex over
a whole text would then run once per use. A one-element array transform keeps it to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_computed(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows for which ``keep`` holds, judged on columns that were costly to compute.

    A plain filter would be pushed below the projection that computes them, which then
    runs twice. Here the finished row is built once and judged as it is.
    """
    row = F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]))
    return df.select(F.inline(F.filter(row, keep)))
