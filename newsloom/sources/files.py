"""Plain file sinks and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from newsloom.schemas import CORPUS, VECTORS


# Full precision, with the zone spelled out.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per row, null fields included; appends unless told otherwise."""
    lines = df.write.mode(mode).option("ignoreNullFields", "false")
    lines.option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)
