"""Discovery to corpus as one chain of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html, text, topics, urls
from newsloom.functions.dates import date_status
from newsloom.operators.filters import rejected_articles, valid_articles
from newsloom.operators.joins import attach_page_text, attribute_topic


def classify(items: DataFrame) -> DataFrame:
    signal = topics.classify_signal(F.col("title"), F.col("excerpt"), F.col("keywords"), F.col("signal_type"))
    return items.withColumn("signal_type", signal)


def stamp(articles: DataFrame, at: Column | None = None) -> DataFrame:
    return articles.withColumn("crawl_ts", F.current_timestamp() if at is None else at)


Extract = Callable[[Column], Column]


def with_page_text(admitted: DataFrame, pages: DataFrame, extract: Extract = html.page_text) -> DataFrame:
    """Admitted items labelled and with the text of their page: all of it, or ``html.main_text``."""
    labelled = attribute_topic(classify(admitted)).withColumn("url_norm", urls.normalize_url(F.col("url")))
    return attach_page_text(labelled, pages, extract(F.col("html")))


def to_articles(
    admitted: DataFrame, pages: DataFrame, at: Column | None = None, extract: Extract = html.page_text
) -> DataFrame:
    """Admitted items to checked articles: text, content id, publisher domain, contract."""
    return finish_articles(with_page_text(admitted, pages, extract), at)


def to_rejects(admitted: DataFrame, pages: DataFrame, extract: Extract = html.page_text) -> DataFrame:
    """The admitted items that ``to_articles`` leaves out, with what they would have been."""
    return rejected_articles(shaped_articles(with_page_text(admitted, pages, extract)))


def finish_articles(fetched: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows that have their content: normalize, hash, check and stamp."""
    return stamp(valid_articles(shaped_articles(fetched)), at).drop("raw_domain", "date_status")


def shaped_articles(fetched: DataFrame) -> DataFrame:
    """Rows as the contract judges them."""
    given = F.col("publisher_domain") if "publisher_domain" in fetched.columns else F.lit(None).cast("string")
    status = (
        F.col("date_status")
        if "date_status" in fetched.columns
        else date_status(F.col("published_date").cast("string"), F.col("published_date"))
    )
    content = text.normalize_text(F.col("content"))
    return (
        fetched.withColumn("content", content)
        .withColumn("content_id", F.sha1("content"))
        .withColumn("extracted_content_length", F.char_length("content"))
        .withColumn("authors", text.drop_null_items(F.col("authors")))
        .withColumn("keywords", text.drop_null_items(F.col("keywords")))
        .withColumn("date_status", status)
        .withColumn("raw_domain", urls.raw_domain(given, F.col("url")))
        .withColumn("publisher_domain", urls.publisher_domain(given, F.col("url")))
    )


def to_corpus_batch(articles: DataFrame) -> DataFrame:
    """The columns the corpus keeps; ``seq`` must be present."""
    return articles.select(
        "seq", "url", "publisher_name", F.col("published_date").alias("date"), "content_id", "title",
        "content", "bucket", "league", "signal_type", "source_type", "source_feed",
    )
