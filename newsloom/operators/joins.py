"""Join operators. Broadcast hints are given only to sides of a known row bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import FOOTBALL_DOMAIN, TOPICS
from newsloom.functions.text import choose_content
from newsloom.functions.urls import normalize_url
from newsloom.sources.topics import bucket_dim, feed_dim

BROADCAST_ROWS = 100_000


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the caller's row bound is small; else Spark decides from sizes."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def anti_join_seen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items whose normalized URL is not persisted yet.

    ``seen`` holds raw URLs, or their stored normal form in ``url_norm``.

    ``items`` should be down to one row per ``url_norm`` already, so that no hot URL
    travels to one task.
    """
    stored = "url_norm" in seen.columns
    known = seen.select("url_norm") if stored else seen.select(normalize_url(F.col("url")).alias("url_norm"))
    return items.join(known, "url_norm", "left_anti")


def pending_embeddings(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    """Corpus rows with a content id that has no vector yet.

    Settled on ids; texts move only in the join with the ids that are pending, and not at all
    where these are few.
    """
    pending = unembedded_ids(corpus, vectors)
    return corpus.select("content_id", "url", "title", "content").join(pending, "content_id", "left_semi")


def unembedded_ids(corpus: DataFrame, vectors: DataFrame) -> DataFrame:
    ids = corpus.where(F.col("content_id").isNotNull()).select("content_id").distinct()
    return ids.join(vectors.select("content_id"), "content_id", "left_anti")


def already_embedded(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """The given content ids, once each, that have a vector."""
    return ids.select("content_id").distinct().join(vectors.select("content_id"), "content_id", "left_semi")


META_COLUMNS = (
    "url", "title", "publisher_name", "date", "content", "bucket", "league", "signal_type",
    "source_type", "source_feed",
)


def hydrate_hits(hits: DataFrame, corpus: DataFrame, rows: int) -> DataFrame:
    """Hits with their corpus row, if any. Url and title prefer the hit, '' counts as missing.

    The corpus is cut to the hits' ids before the outer join, so only matching rows move.
    ``rows`` bounds the number of hits. A corpus without contents gives hits without.
    """
    told = [c for c in META_COLUMNS if c != "content" or c in corpus.columns]
    meta = corpus.select("content_id", *[F.col(c).alias(f"_m_{c}") for c in told])
    wanted = meta.join(hint_small(hits.select("content_id"), rows), "content_id", "left_semi")
    joined = hits.join(wanted, "content_id", "left")
    kept = [c for c in hits.columns if c not in ("url", "title")]
    return joined.select(
        *kept,
        F.coalesce(F.nullif("url", F.lit("")), "_m_url", F.lit("")).alias("url"),
        F.coalesce(F.nullif("title", F.lit("")), "_m_title").alias("title"),
        *[F.col(f"_m_{c}").alias(c) for c in told if c not in ("url", "title")],
    )


def wanted_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(url_norm, html) of the pages the items need, one per normalized URL.

    Which page serves a URL (the lowest ``page_id``) is settled on narrow columns. A small
    set of items is then broadcast by size, so page bodies are not shuffled.
    """
    narrow = pages.select("page_id", normalize_url(F.col("url")).alias("url_norm"))
    chosen = (
        narrow.join(items.select("url_norm"), "url_norm", "left_semi")
        .groupBy("url_norm")
        .agg(F.min("page_id").alias("page_id"))
    )
    return pages.select("page_id", "html").join(chosen, "page_id").select("url_norm", "html")


def attach_page_text(items: DataFrame, pages: DataFrame, text: Column) -> DataFrame:
    """Items with the text chosen from their stored page, excerpt and paywall flag.

    ``text`` is the extraction expression over the page's ``html``. It is computed where the
    page is found, so that texts, not pages, move to the items.
    """
    open_items = items.where(~F.coalesce(F.col("paywall"), F.lit(False)))
    texts = wanted_pages(open_items, pages).select("url_norm", text.alias("_page_text"))
    joined = items.join(texts, "url_norm", "left")
    chosen = choose_content(F.col("paywall"), F.col("_page_text"), F.col("excerpt"))
    return joined.withColumn("content", chosen).drop("_page_text")


def attach_config(items: DataFrame, topics=TOPICS) -> DataFrame:
    """Items with their topic's domain, label, query and visiting position."""
    dim = bucket_dim(items.sparkSession, topics)
    return items.join(hint_small(dim, len(topics)), "bucket", "inner")


def attach_feed(items: DataFrame, topics=TOPICS) -> DataFrame:
    """Feed bodies keyed by ``feed_url`` with their configured bucket, position and name."""
    dim = feed_dim(items.sparkSession, topics).select(
        "bucket", F.col("pos").alias("feed_pos"), F.col("name").alias("feed_name"), F.col("url").alias("feed_url")
    )
    return items.join(hint_small(dim, sum(len(t[4]) for t in topics)), "feed_url", "inner")


def attribute_topic(items: DataFrame, topics=TOPICS) -> DataFrame:
    """Replace the config key in ``bucket`` by its domain; football keys become the league."""
    dim = bucket_dim(items.sparkSession, topics).select("bucket", F.col("domain").alias("_domain"))
    joined = items.drop("league").join(hint_small(dim, len(topics)), "bucket", "left")
    return joined.withColumn(
        "league", F.when(F.col("_domain") == FOOTBALL_DOMAIN, F.col("bucket"))
    ).withColumn("bucket", F.coalesce("_domain", "bucket")).drop("_domain")
