"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every node's neighbours on the smallest node near it (Kiveris et al. 2014).
The number of links never grows; rounds are written to the shared folder, so nothing is
recomputed. Two bigint columns, a and b; nodes without links do not appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    low = low.select("node", F.least("node", "m").alias("m"))
    low = materialize(low, "links-low")  # stored, so that the join can split a hub's links
    moved = both.join(low, F.col("a") == F.col("node"))
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = low.select(F.col("node").alias("a"), F.col("m").alias("b"))
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.where("a <> b").distinct()


def connected(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root): the smallest node of each node's component."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), label)
    state = None
    while True:  # the rounds grow with the logarithm of the number of links
        links = materialize(_star(_star(links, True), False), label)
        now = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
            F.sum(F.col("b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
