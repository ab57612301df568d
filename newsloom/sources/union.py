"""Combining items of several sources into one discovery table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*sources: DataFrame) -> DataFrame:
    """All items with the ordinal of their source; columns a source lacks become null."""
    tagged = [s.withColumn("source_ordinal", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def align_schema(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of ``schema``; missing ones are added as typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
