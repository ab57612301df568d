"""Statistics of a table kept up by its commits, so that a reader scans no rows.

A commit's state has one row per key it touches: rows added less rows taken away, and the ends
of the dates added. States add up in any grouping. What cannot be taken back is an end of a
day whose row goes: such a day is counted anew by the commit, and its row is marked fresh,
which puts earlier states of the day aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.aggregates import key_counts
from newsloom.session import materialize

STATE = "section string, key string, n bigint, lo timestamp, hi timestamp, fresh boolean"
FACTS = ("url", "publisher_name", "bucket", "signal_type", "date")
BASE = "base"  # the section of the row that says: earlier states are in this one


def _shaped(counts: DataFrame, sign: int = 1, fresh: bool = False) -> DataFrame:
    end = lambda c: (F.col(c) if sign > 0 else F.lit(None).cast("timestamp")).alias(c)
    return counts.select(
        "section", F.coalesce("key", F.lit("")).alias("key"), (sign * F.col("value")).alias("n"), end("lo"), end("hi"),
        F.lit(fresh).alias("fresh"),
    )


def base_state(rows: DataFrame) -> DataFrame:
    """The state of a whole table, which needs no earlier one."""
    mark = rows.sparkSession.createDataFrame([(BASE, "", 0, None, None, True)], STATE)
    return _shaped(key_counts(rows.select(*FACTS)), fresh=True).unionByName(mark)


def commit_state(added: DataFrame, removed: DataFrame, after: DataFrame, kept: DataFrame) -> DataFrame:
    """What a commit adds to the kept statistics.

    ``removed`` are the rows that the rows ``added`` replace, ``after`` the table as it will
    be, of which only the dates of days that lose an end are read, and ``kept`` the merged
    states before the commit.
    """
    both = _shaped(key_counts(added.select(*FACTS))).unionByName(_shaped(key_counts(removed.select(*FACTS)), -1))
    delta = both.groupBy("section", "key").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.lit(False).alias("fresh")
    )
    day = F.to_date("date").cast("string")
    gone = removed.where(F.col("date").isNotNull()).groupBy(day.alias("key")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    ends = kept.where("section = 'day'").select("key", F.col("lo").alias("first"), F.col("hi").alias("last"))
    stale = materialize(gone.join(ends, "key").where("a <= first or b >= last").select("key"), "stats-stale")
    bounds = stale.agg(F.min("key"), F.max("key")).first()
    if bounds[0] is None:
        return delta
    near = after.where(F.col("date") >= F.lit(bounds[0]).cast("date")).where(F.col("date") < F.date_add(F.lit(bounds[1]).cast("date"), 1))
    counted = near.groupBy(day.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    anew = stale.join(counted, "key", "left").select(
        F.lit("day").alias("section"), "key", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", F.lit(True).alias("fresh")
    )
    others = delta.join(stale.select(F.lit("day").alias("section"), "key"), ["section", "key"], "left_anti")
    return others.unionByName(anew.select(others.columns))


def merged(states: DataFrame) -> DataFrame:
    """(section, key, n, lo, hi) over the states of commits, those put aside left out."""
    last = F.max(F.when(F.col("fresh"), F.col("commit")))
    since = states.groupBy("section", "key").agg(F.coalesce(last, F.lit(0)).alias("since"))
    live = states.join(since, ["section", "key"]).where(F.col("commit") >= F.col("since"))
    return live.groupBy("section", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def kept_counts(states: DataFrame) -> DataFrame:
    """``key_counts`` of the table, from its states alone."""
    found = merged(states).where("n > 0 or section = 'total'")
    days = found.where("section = 'day'").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = found.where("section = 'total'").select("section", F.lit(None).cast("string").alias("key"), F.col("n").alias("value"))
    others = found.where(~F.col("section").isin("total", BASE)).select("section", "key", F.col("n").alias("value"), "lo", "hi")
    return others.unionByName(total.crossJoin(days))  # one row each
