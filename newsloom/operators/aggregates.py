"""Corpus statistics. Every count is a partial aggregate before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.config import DUP_RATE_BAD, DUP_WINDOW_PAGES, TIMELINE_DAYS, TOP_PUBLISHERS
from newsloom.operators.ranking import running_position
from newsloom.session import materialize


def total_articles(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("total"))


def counts_by(corpus: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value of a column."""
    return corpus.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_publishers(corpus: DataFrame, k: int = TOP_PUBLISHERS) -> DataFrame:
    return counts_by(corpus, "publisher_name").orderBy(F.desc("n"), "publisher_name").limit(k)


def by_bucket(corpus: DataFrame) -> DataFrame:
    return counts_by(corpus, "bucket")


def by_signal_type(corpus: DataFrame) -> DataFrame:
    return counts_by(corpus, "signal_type")


def date_range(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))


def daily_timeline(corpus: DataFrame, days: int = TIMELINE_DAYS) -> DataFrame:
    """Counts of the latest days that have articles, oldest first."""
    daily = (
        corpus.where(F.col("date").isNotNull())
        .groupBy(F.to_date("date").alias("pub_day"))
        .agg(F.count("*").alias("n"))
    )
    return daily.orderBy(F.desc("pub_day")).limit(days).orderBy("pub_day")


def filter_values(corpus: DataFrame) -> DataFrame:
    """Distinct buckets and signal types as (kind, value), in one pass over the corpus."""
    pairs = corpus.select(
        F.explode(
            F.array(
                F.struct(F.lit("bucket").alias("kind"), F.col("bucket").alias("value")),
                F.struct(F.lit("signal_type").alias("kind"), F.col("signal_type").alias("value")),
            )
        ).alias("p")
    ).select("p.kind", "p.value")
    return pairs.where(F.col("value").isNotNull()).distinct().orderBy("kind", "value")


def unique_publishers(corpus: DataFrame, approximate: bool = False, k: int = TOP_PUBLISHERS) -> DataFrame:
    """Number of publishers, and that number capped at the length of the top list."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    exact = corpus.agg(count(F.col("publisher_name")).alias("unique_publishers"))
    return exact.withColumn("top_publisher_count", F.least("unique_publishers", F.lit(k).cast("bigint")))


def key_counts(corpus: DataFrame) -> DataFrame:
    """(section, key, value, lo, hi): rows and ends of the dates per publisher, bucket, signal type, day, and in all.

    Grouping sets give each row one key per section; the counts are combined map-side, so
    what is shuffled is the number of distinct keys, whatever the skew. The total's key is null.
    """
    facts = corpus.select(
        "publisher_name", "bucket", "signal_type", F.to_date("date").alias("pub_day"), "date"
    )
    grouped = facts.groupingSets(
        [
            [],
            [F.col("publisher_name")],
            [F.col("bucket")],
            [F.col("signal_type")],
            [F.col("pub_day")],
        ],
        F.col("publisher_name"),
        F.col("bucket"),
        F.col("signal_type"),
        F.col("pub_day"),
    ).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.min("date").alias("lo"),
        F.max("date").alias("hi"),
    )
    section = (
        F.when(F.col("gid") == 0b0111, "publisher")
        .when(F.col("gid") == 0b1011, "bucket")
        .when(F.col("gid") == 0b1101, "signal_type")
        .when(F.col("gid") == 0b1110, "day")
        .otherwise("total")
    )
    return grouped.select(
        section.alias("section"),
        F.coalesce("publisher_name", "bucket", "signal_type", F.col("pub_day").cast("string")).alias("key"),
        F.col("n").alias("value"), "lo", "hi",
    ).where((F.col("section") == "total") | F.col("key").isNotNull())


def corpus_stats(
    corpus: DataFrame, top: int = TOP_PUBLISHERS, days: int = TIMELINE_DAYS
) -> DataFrame:
    """All statistics as (section, key, value) from a single scan."""
    # One row per distinct key: written once so that the parts share the corpus scan.
    return stats_of(materialize(key_counts(corpus), "corpus-stats"), top, days)


def stats_of(keyed: DataFrame, top: int = TOP_PUBLISHERS, days: int = TIMELINE_DAYS) -> DataFrame:
    """All statistics as (section, key, value) from stored ``key_counts``."""
    entry = ["section", "key", "value"]

    def part(name: str) -> DataFrame:
        return keyed.where(F.col("section") == name)

    def constant(name: str, key: str, value) -> DataFrame:
        return F.struct(F.lit(name).alias("section"), F.lit(key).alias("key"), value.cast("bigint").alias("value"))

    whole = part("total").agg(
        F.coalesce(F.max("value"), F.lit(0)).alias("value"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
    )
    totals = whole.select(
        F.inline(
            F.array(
                constant("total", "articles", F.col("value")),
                constant("date_range", "earliest_micros", F.unix_micros("lo")),
                constant("date_range", "latest_micros", F.unix_micros("hi")),
            )
        )
    )
    publishers = part("publisher").agg(F.count("*").alias("value"))
    return (
        part("publisher").orderBy(F.desc("value"), "key").limit(top).select(*entry)
        .unionByName(part("day").orderBy(F.desc("key")).limit(days).select(*entry))
        .unionByName(part("bucket").select(*entry))
        .unionByName(part("signal_type").select(*entry))
        .unionByName(totals)
        .unionByName(
            publishers.select(F.lit("total").alias("section"), F.lit("unique_publishers").alias("key"), "value")
        )
    )


def embedding_stats(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """Vector count and dimension, and the share of corpus contents that have a vector."""
    ids = corpus.where(F.col("content_id").isNotNull()).select("content_id").distinct()
    covered = ids.join(
        vectors.select("content_id", F.lit(1).alias("_hit")).distinct(), "content_id", "left"
    ).agg(F.count("*").alias("corpus_contents"), F.count("_hit").alias("embedded_contents"))
    sizes = vectors.agg(
        F.count("*").alias("embedding_count"), F.max(F.size("embedding")).cast("bigint").alias("embedding_dim")
    )
    numbers = ("embedding_count", "embedding_dim", "corpus_contents", "embedded_contents")
    merged = sizes.unionByName(covered, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in numbers])
    share = F.col("embedded_contents") / F.nullif("corpus_contents", F.lit(0).cast("bigint"))
    return merged.withColumn("coverage", F.round(share, 4))


def page_dup_rate(decided: DataFrame) -> DataFrame:
    """Accepted, rejected and rejected share per (bucket, page) of counted items.

    ``decided`` has one row per item with ``accepted``; items behind a full quota, which
    the visit never looks at, must be left out by the caller.
    """
    flag = F.col("accepted").cast("bigint")
    return (
        decided.groupBy("bucket", "page")
        .agg(F.sum(flag).alias("accepted"), F.sum(1 - flag).alias("rejected"))
        .withColumn("dup_rate", F.col("rejected") / (F.col("accepted") + F.col("rejected")))
    )


def rolling_dup_rate(
    rates: DataFrame, window_pages: int = DUP_WINDOW_PAGES, bad: float = DUP_RATE_BAD, block_pages: int = 4096
) -> DataFrame:
    """Mean dup rate over each bucket's last pages, flagged when the window is full and bad.

    Each page row is sent to the windows it belongs to by position, so a bucket of any
    length is spread over tasks; no window function spans a bucket.
    """
    placed = running_position(
        rates, ["bucket"], [F.col("page").asc()], F.floor(F.col("page") / block_pages), "visit"
    )
    spread = placed.select(
        "bucket", "page", "dup_rate", "visit",
        F.explode(F.sequence(F.lit(0), F.lit(window_pages - 1))).alias("lag"),
    )
    own = F.col("lag") == 0
    windows = (
        spread.groupBy("bucket", (F.col("visit") + F.col("lag")).alias("visit"))
        .agg(
            F.max(F.when(own, F.col("page"))).alias("page"),
            F.max(F.when(own, F.col("dup_rate"))).alias("dup_rate"),
            F.collect_list(F.struct((-F.col("lag")).alias("age"), "dup_rate")).alias("_rates"),
            F.count("*").alias("window_size"),
        )
        .where(F.col("page").isNotNull())
    )
    # At most ``window_pages`` rates, added oldest first so that sums are reproducible.
    total = F.aggregate(F.array_sort("_rates"), F.lit(0.0), lambda acc, r: acc + r["dup_rate"])
    mean = total / F.col("window_size")
    return windows.select(
        "bucket", "page", "dup_rate", mean.alias("mean_dup_rate"), "window_size",
        ((F.col("window_size") == window_pages) & (mean > bad)).alias("flagged"),
    )


def discovery_summary(admitted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Accepted rows per bucket, their total, and the number of already-known URLs."""
    counts = admitted.rollup("bucket").agg(F.grouping("bucket").alias("_all"), F.count("*").alias("n"))
    rows = counts.select(
        F.when(F.col("_all") == 1, "total").otherwise("bucket").alias("kind"), "bucket", "n"
    )
    known = seeds.agg(F.count_distinct("url_norm").alias("n"))
    return rows.unionByName(known.select(F.lit("seeds").alias("kind"), F.lit(None).cast("string").alias("bucket"), "n"))
