"""Tables that are replaced or updated while being read.

A commit becomes visible through one appended log record, written after its data. Readers
pick files by partition values from the log, so an unfinished or failed commit is never
seen and a repeated one is skipped.

Corpus rows live under ``commit=<n>/ub=<k>`` where ``ub`` is a hash of the URL. New URLs
are appended; only the ``ub`` partitions holding a changed URL are written again. With
``stats`` every commit also keeps what it changes in the table's statistics, under
``stats/commit=<n>``, which ``read_stats`` adds up without a look at the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import kept_stats
from newsloom.operators.aggregates import stats_of
from newsloom.operators.upsert import corpus_changes
from newsloom.schemas import CORPUS
from newsloom.session import materialize
from newsloom.sources.files import write_jsonl

LOG_SCHEMA = "commit bigint, rewritten array<int>, tag string"


@dataclass
class LogState:
    latest: int
    base: dict[int, int]


def _read_log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG_SCHEMA).json(f"{root}/log")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _append_log(spark: SparkSession, root: str, commit: int, rewritten: list[int], tag: str | None) -> None:
    record = spark.createDataFrame([(commit, rewritten, tag)], LOG_SCHEMA)
    record.coalesce(1).write.mode("append").json(f"{root}/log")


def has_tag(spark: SparkSession, root: str, tag: str) -> bool:
    log = _read_log(spark, root)
    return log is not None and not log.where(F.col("tag") == tag).isEmpty()


def _state(spark: SparkSession, root: str) -> LogState:
    log = _read_log(spark, root)
    if log is None:
        return LogState(0, {})
    latest = log.agg(F.max("commit")).first()[0] or 0
    # One row per partition number ever rewritten: bounded by the table's ``buckets``.
    base = log.select("commit", F.explode("rewritten").alias("ub")).groupBy("ub").agg(F.max("commit").alias("c"))
    return LogState(latest, {r["ub"]: r["c"] for r in base.toLocalIterator()})


class CorpusTable:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, stats: bool = False):
        self.spark, self.root, self.buckets, self.stats = spark, root.rstrip("/"), buckets, stats

    def _bucket(self):
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def _live(self, state: LogState) -> DataFrame:
        """Rows of the current version; the conditions are on partition columns only."""
        if not state.latest:
            return self.spark.createDataFrame([], CORPUS).withColumn("ub", F.lit(0))
        stored = self.spark.read.schema(
            f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CORPUS.fields)}, commit bigint, ub int"
        ).parquet(f"{self.root}/rows")
        since = F.lit([state.base.get(i, 0) for i in range(self.buckets)])
        current = (F.col("commit") <= state.latest) & (F.col("commit") >= F.get(since, F.col("ub")))
        return stored.where(current).drop("commit")

    def read(self) -> DataFrame:
        return self._live(_state(self.spark, self.root)).drop("ub")

    def _states(self, latest: int) -> DataFrame | None:
        """The statistics' states of the visible commits, from the last whole one on."""
        try:
            stored = self.spark.read.schema(f"{kept_stats.STATE}, commit bigint").parquet(f"{self.root}/stats")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        stored = stored.where(F.col("commit") <= latest)
        base = stored.where(F.col("section") == kept_stats.BASE).agg(F.max("commit")).first()[0]
        return None if base is None else stored.where(F.col("commit") >= base)

    def read_stats(self) -> DataFrame:
        """``corpus_stats`` of the table, from the states that its commits kept."""
        states = self._states(_state(self.spark, self.root).latest)
        if states is None:
            raise RuntimeError("no commit kept statistics")
        return stats_of(materialize(kept_stats.kept_counts(states), "kept-stats"))

    def _write_stats(self, state: LogState, live: DataFrame, changes: DataFrame, rewritten: list[int], commit: int) -> None:
        after = live.join(changes.select("url"), "url", "left_anti").select(*kept_stats.FACTS)
        after = after.unionByName(changes.select(*kept_stats.FACTS))
        states = self._states(state.latest)
        if states is None:  # the first commit, or the first with statistics
            record = kept_stats.base_state(after)
        else:
            removed = live.where(F.col("ub").isin(rewritten)).join(changes.where("is_update").select("url"), "url", "left_semi")
            record = kept_stats.commit_state(changes, removed, after, kept_stats.merged(states))
        record.write.mode("overwrite").parquet(f"{self.root}/stats/commit={commit}")

    def upsert(
        self, batch: DataFrame, tag: str | None = None, batch_ts=None, jsonl_path: str | None = None
    ) -> int:
        """Apply an ordered batch. A ``tag`` seen before makes the call a no-op.

        With ``jsonl_path`` the rows written are also kept as JSON lines, in a folder of
        their own per commit, before the commit becomes visible.
        """
        if tag is not None and has_tag(self.spark, self.root, tag):
            return 0
        state = _state(self.spark, self.root)
        live = self._live(state)
        changes = corpus_changes(live.drop("ub"), batch, batch_ts).withColumn("ub", self._bucket())
        if jsonl_path is not None:
            changes = materialize(changes, "changes")  # whole rows are written twice
        rewritten = sorted(r["ub"] for r in changes.where("is_update").select("ub").distinct().collect())
        new = changes.drop("is_update")
        if rewritten:
            kept = live.where(F.col("ub").isin(rewritten)).join(new.select("url"), "url", "left_anti")
            if not kept.select("url").isEmpty():  # told by URLs; texts move where some stay
                new = new.unionByName(kept.select(new.columns))
        commit = state.latest + 1
        # By size: AQE gives a large bucket several tasks, and small ones share a task.
        spread = new.hint("rebalance", "ub")
        spread.sortWithinPartitions("ub", "date").write.mode("overwrite").partitionBy("ub").parquet(f"{self.root}/rows/commit={commit}")
        if self.stats:
            self._write_stats(state, live, changes, rewritten, commit)
        if jsonl_path is not None:
            write_jsonl(changes.drop("is_update", "ub", "url_norm"), f"{jsonl_path}/commit={commit}", "overwrite")
        _append_log(self.spark, self.root, commit, rewritten, tag)
        return commit

    def compact(self) -> int:
        """Rewrite the current version as one commit, so that readers open few files."""
        state = _state(self.spark, self.root)
        commit = state.latest + 1
        live = self._live(state).hint("rebalance", "ub")
        live.sortWithinPartitions("ub", "date").write.mode("overwrite").partitionBy("ub").parquet(
            f"{self.root}/rows/commit={commit}"
        )
        if self.stats:
            kept_stats.base_state(self._live(state)).write.mode("overwrite").parquet(f"{self.root}/stats/commit={commit}")
        _append_log(self.spark, self.root, commit, list(range(self.buckets)), None)
        return commit


def publish_snapshot(df: DataFrame, root: str) -> int:
    """Replace the table at ``root`` by ``df``; readers see the old or the new one, whole."""
    spark = df.sparkSession
    commit = _state(spark, root).latest + 1
    df.write.mode("overwrite").parquet(f"{root}/rows/commit={commit}")
    _append_log(spark, root, commit, [], None)
    return commit


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/rows/commit={_state(spark, root).latest}")
