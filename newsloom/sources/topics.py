"""The topic configuration as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import TOPICS

_SCHEMA = (
    "bucket string, bucket_pos int, domain string, label string, query string, "
    "feeds array<struct<name:string,url:string>>"
)


def topic_table(spark: SparkSession, topics=TOPICS) -> DataFrame:
    rows = [
        (key, i, domain, label, query, [tuple(f) for f in feeds])
        for i, (key, domain, label, query, feeds) in enumerate(topics)
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def bucket_dim(spark: SparkSession, topics=TOPICS) -> DataFrame:
    return topic_table(spark, topics).drop("feeds")


def feed_dim(spark: SparkSession, topics=TOPICS) -> DataFrame:
    exploded = topic_table(spark, topics).select("bucket", F.posexplode("feeds").alias("pos", "feed"))
    return exploded.select("bucket", "pos", "feed.name", "feed.url")
