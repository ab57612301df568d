"""First-k and running-position operators that survive one huge key.

``first_k`` relies on the group-limit Spark plans below a ``row_number() <= k`` filter:
each input task keeps at most k rows per key before the shuffle, so a key holding a
third of all rows still sends only k rows per task. That holds up to Spark's limit
threshold; past it, positions come from block counts and no task sees a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP_LIMIT_THRESHOLD = 1000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def running_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str = "position"
) -> DataFrame:
    """1-based position of each row within its key.

    ``block`` must be non-decreasing along ``order``. Rows are numbered within
    (key, block); only block counts are summed per key.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inner = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order))
    return (
        blocked.withColumn("_inner", inner)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_inner")).cast("bigint"))
        .drop("_block", "_inner", "_before")
    )


def first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: Column, k_max: int, block: Column,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each key; ``k`` may differ per row of a key-constant column.

    ``k_max`` is an upper bound of ``k`` over all keys. ``rank`` names a column to keep
    the row's number in.
    """
    if k_max <= GROUP_LIMIT_THRESHOLD:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        ranked = df.withColumn("_rn", number)
    else:
        ranked = running_position(df, keys, order, block, "_rn")
    kept = ranked.where((F.col("_rn") <= k_max) & (F.col("_rn") <= k))
    return kept.withColumnRenamed("_rn", rank) if rank else kept.drop("_rn")


def nearest_in_key(
    df: DataFrame, key: str, order: str, value: Column, *, before: bool, block: Column | None, name: str
) -> DataFrame:
    """The nearest non-null ``value`` strictly before (or after) each row within its key.

    Works block by block: inside a block with a window, across blocks with one value
    per (key, block). Without ``block`` a key is one window, for tables known to be small.
    """
    along = F.col(order).asc() if before else F.col(order).desc()
    if block is None:
        whole = W.partitionBy(key).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
        valued = df.withColumn("_value", value)
        return valued.withColumn(name, F.last("_value", ignorenulls=True).over(whole)).drop("_value")
    along_block = F.col("_block").asc() if before else F.col("_block").desc()
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    inside = F.last("_value", ignorenulls=True).over(
        W.partitionBy(key, "_block").orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    )
    pick = F.max_by if before else F.min_by
    edges = (
        blocked.where(F.col("_value").isNotNull())
        .groupBy(key, "_block")
        .agg(pick("_value", order).alias("_edge"))
    )
    # Blocks without a value still need the carry of their predecessors.
    blocks = blocked.select(key, "_block").distinct().join(edges, [key, "_block"], "left")
    carry = F.last("_edge", ignorenulls=True).over(
        W.partitionBy(key).orderBy(along_block).rowsBetween(W.unboundedPreceding, -1)
    )
    carries = blocks.select(key, "_block", carry.alias("_carry"))
    return (
        blocked.withColumn("_inside", inside)
        .join(carries, [key, "_block"])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_block", "_value", "_inside", "_carry")
    )
