"""Continuous ingestion: discovered files in, corpus table out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsloom.functions.urls import normalize_url
from newsloom.operators.joins import anti_join_seen
from newsloom.operators.ranking import first_per_key
from newsloom.session import materialize, scratch
from newsloom.sources.tables import CorpusTable, has_tag


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100, fmt: str = "parquet") -> DataFrame:
    """Files as they arrive; ``files_per_batch`` bounds the work in flight."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_stream(
    items: DataFrame, table: CorpusTable, name: str, checkpoint: str, to_batch: Callable[[DataFrame], DataFrame],
    jsonl_path: str | None = None, rejects: Callable[[DataFrame], DataFrame] | None = None, rejects_path: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Start ingestion of all available input; the query ends when it is drained.

    ``to_batch`` turns a micro-batch of items into corpus rows with ``seq``. The table
    records ``name`` and the batch id, so a batch that is delivered again after a failure is
    skipped. ``name`` must be the stream's own: ids start at 0 in every stream. Rows that
    ``rejects`` gives of a micro-batch go to ``rejects_path``, a folder per batch. ``prepare``
    is what both have in common: it is computed once, against the table as the batch finds it.
    """

    def apply(micro_batch: DataFrame, batch_id: int) -> None:
        tag = f"{name}-{batch_id}"
        if has_tag(table.spark, table.root, tag):
            return
        with scratch(table.spark):
            if prepare is not None:
                micro_batch = materialize(prepare(micro_batch), "prepared")
            if rejects is not None and rejects_path is not None:
                rejects(micro_batch).write.mode("overwrite").parquet(f"{rejects_path}/{tag}")
            rows = materialize(to_batch(micro_batch), "micro-batch")
            table.upsert(rows, tag=tag, jsonl_path=jsonl_path)

    return (
        items.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def known_urls(*tables: DataFrame) -> DataFrame:
    """The normalized URLs of tables that hold raw ones, or hold them in ``url_norm``."""
    own = lambda t: F.col("url_norm") if "url_norm" in t.columns else normalize_url(F.col("url")).alias("url_norm")
    return reduce(DataFrame.unionByName, [t.select(own(t)) for t in tables])


def dedup_against_corpus(micro_batch: DataFrame, corpus: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row in ``order`` of each new URL of a micro-batch; the state is the corpus table itself."""
    keyed = micro_batch.withColumn("url_norm", normalize_url(F.col("url")))
    return anti_join_seen(first_per_key(keyed, ["url_norm"], order), corpus)


def dedup_stream(items: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row per normalized URL, with state kept by Spark.

    With a watermark (column, delay) the state of old URLs is let go.
    """
    keyed = items.withColumn("url_norm", normalize_url(F.col("url")))
    if watermark is None:
        return keyed.dropDuplicates(["url_norm"])
    return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["url_norm"])
