"""Duplicate rates of visited pages while they arrive.

A bucket's state is its last pages with their counts. A micro-batch gives anew the rates of
the pages it touches and of those whose windows they are in, so pages may come in any number
of parts and out of order. The last row given of a page is the one that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.config import DUP_RATE_BAD, DUP_WINDOW_PAGES

KEPT_PAGES = 256
COUNTS = "bucket string, page bigint, accepted bigint, rejected bigint"
STATE = "pages array<bigint>, accepted array<bigint>, rejected array<bigint>, forgotten bigint"
RATES = (
    "bucket string, page bigint, dup_rate double, mean_dup_rate double, window_size bigint, flagged boolean, late bigint"
)


def batch_counts(decided: DataFrame) -> DataFrame:
    """(bucket, page, accepted, rejected) summed within each Arrow batch, so that few rows meet at a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took = pc.cast(batch.column("accepted"), pa.int64())
            rows = pa.table([batch.column("bucket"), batch.column("page"), took, pc.subtract(1, took)], ["bucket", "page", "a", "r"])
            sums = rows.group_by(["bucket", "page"]).aggregate([("a", "sum"), ("r", "sum")])
            sums = sums.select(["bucket", "page", "a_sum", "r_sum"]).rename_columns(["bucket", "page", "accepted", "rejected"])
            yield from sums.to_batches()

    rows = decided.where(F.col("accepted").isNotNull()).select("bucket", F.col("page").cast("bigint").alias("page"), "accepted")
    return rows.mapInArrow(run, COUNTS)


def rate_rows(
    pages: list[int], accepted: list[int], rejected: list[int], touched: set[int], forgotten: int, window: int, bad: float
) -> list[tuple]:
    """Rates of the touched pages and of those in whose windows they are; ``pages`` in order.

    ``forgotten`` pages lie ahead of the first. Its windows and those of the next few would
    lack them, so they are given only while nothing is forgotten.
    """
    rates = [r / (a + r) if a + r else 0.0 for a, r in zip(accepted, rejected)]
    changed = {at + k for at, page in enumerate(pages) if page in touched for k in range(window)}
    rows = []
    for at in sorted(changed):
        if at >= len(pages) or (forgotten and at < window - 1):
            continue
        last = rates[max(0, at + 1 - window) : at + 1]
        mean = reduce(add, last) / len(last)  # one after the other; ``sum`` would round otherwise than Spark
        rows.append((pages[at], rates[at], mean, len(last), len(last) == window and mean > bad, 0))
    return rows


def stream_dup_rate(
    decided: DataFrame, window: int = DUP_WINDOW_PAGES, bad: float = DUP_RATE_BAD, kept: int = KEPT_PAGES
) -> DataFrame:
    """``rolling_dup_rate`` of a stream of decided items (bucket, page, accepted), as updates.

    A bucket's ``kept`` last pages may still get items. Items of pages before them change no
    rate; their number is given in ``late``, in a row without rates. Items without a decision
    count for nothing; a null bucket is a bucket.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, accepted, rejected, forgotten = ([], [], [], 0)
        if state.exists:
            pages, accepted, rejected, forgotten = (list(x) if not isinstance(x, int) else x for x in state.get)
        known = {p: (a, r) for p, a, r in zip(pages, accepted, rejected)}
        first = pages[window - 1] if forgotten else None  # those ahead only fill the windows of later ones
        touched, late = set(), {}
        for part in parts:
            for page, a, r in zip(part["page"].tolist(), part["accepted"].tolist(), part["rejected"].tolist()):
                if first is not None and page < first:
                    late[page] = late.get(page, 0) + a + r
                    continue
                had = known.get(page, (0, 0))
                known[page] = had[0] + a, had[1] + r
                touched.add(page)
        pages = sorted(known)
        accepted, rejected = [known[p][0] for p in pages], [known[p][1] for p in pages]
        rows = rate_rows(pages, accepted, rejected, touched, forgotten, window, bad)
        drop = max(0, len(pages) - kept - window + 1)
        state.update((pages[drop:], accepted[drop:], rejected[drop:], forgotten + drop))
        rows += [(page, None, None, 0, False, n) for page, n in late.items()]
        if rows:
            columns = ["page", "dup_rate", "mean_dup_rate", "window_size", "flagged", "late"]
            found = pd.DataFrame(rows, columns=columns)
            found.insert(0, "bucket", pd.Series([key[0]] * len(rows), dtype=object))
            yield found

    return batch_counts(decided).groupBy("bucket").applyInPandasWithState(
        update, RATES, STATE, "update", GroupStateTimeout.NoTimeout
    )


def write_rates(rates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the updates of all available input, a folder a micro-batch; one delivered again replaces its own."""

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rates.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rates that hold now: the last update of each page, without the late ones."""
    try:
        rows = spark.read.schema(f"{RATES}, batch bigint").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], f"{RATES}, batch bigint")
    row = F.struct("dup_rate", "mean_dup_rate", "window_size", "flagged")
    last = rows.where("late = 0").groupBy("bucket", "page").agg(F.max_by(row, "batch").alias("last"))
    return last.select("bucket", "page", "last.*")
