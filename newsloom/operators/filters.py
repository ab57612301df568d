"""Row filters of the corpus queries and the article contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import CONTENT_ID_CHARS, MAX_URL_CHARS, MIN_CONTENT_CHARS, MIN_DOMAIN_CHARS
from newsloom.functions.binding import keep_computed
from newsloom.functions.dates import parse_query_date


def equals_if_given(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on each given column; None or '' means no filter."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def filter_bucket_signal(df: DataFrame, bucket: str | None = None, signal_type: str | None = None) -> DataFrame:
    return equals_if_given(df, bucket=bucket, signal_type=signal_type)


def _like(column: str, text: str) -> Column:
    """Case-insensitive substring match in which % and _ keep their wildcard meaning."""
    pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
    return F.lower(F.col(column)).like(pattern)


def filter_publisher(df: DataFrame, publisher_name: str | None = None) -> DataFrame:
    return df.where(_like("publisher_name", publisher_name)) if publisher_name else df


def filter_date_range(
    df: DataFrame, date_from: str | None = None, date_to: str | None = None, column: str = "date"
) -> DataFrame:
    """``column >= from`` and ``column < to + 1 day``; an unreadable bound is no bound.

    Bounds fold to literals, so the comparison reaches the scan.
    """
    spark = df.sparkSession
    lower, upper = (
        spark.range(1)
        .select(
            parse_query_date(F.lit(date_from).cast("string")).alias("a"),
            (parse_query_date(F.lit(date_to).cast("string")) + F.expr("interval 1 day")).alias("b"),
        )
        .selectExpr("cast(a as string)", "cast(b as string)")
        .first()
    )
    if lower is not None:
        df = df.where(F.col(column) >= F.lit(lower).cast("timestamp"))
    if upper is not None:
        df = df.where(F.col(column) < F.lit(upper).cast("timestamp"))
    return df


def where_corpus(
    df: DataFrame, *, bucket=None, signal_type=None, publisher_name=None, date_from=None, date_to=None
) -> DataFrame:
    """All browse filters together."""
    df = filter_bucket_signal(df, bucket, signal_type)
    return filter_date_range(filter_publisher(df, publisher_name), date_from, date_to)


def keyword_match(df: DataFrame, text: str) -> DataFrame:
    return df.where(_like("title", text) | _like("content", text))


def filter_articles(
    df: DataFrame, *, league=None, signal_type=None, date_from=None, date_to=None, date_column="published_date"
) -> DataFrame:
    """League and signal equality with an inclusive date window."""
    df = equals_if_given(df, league=league, signal_type=signal_type)
    return filter_date_range(df, date_from, date_to, date_column)


def min_similarity(df: DataFrame, floor: float) -> DataFrame:
    """Hits at or above the floor; NaN (a zero vector) never passes."""
    return df.where(~F.isnan("similarity") & (F.col("similarity") >= floor))


def post_filter_hits(df: DataFrame, topic: str | None = None, signal_type: str | None = None) -> DataFrame:
    """``topic`` may match league or bucket; rows without metadata fail a given filter."""
    if topic:
        df = df.where((F.col("league") == topic) | (F.col("bucket") == topic))
    return equals_if_given(df, signal_type=signal_type)


def admissible_url(df: DataFrame) -> DataFrame:
    """Rows with a normalized URL and a host; judged after both were computed."""
    return keep_computed(df, lambda row: (row["url_norm"] != "") & (row["domain"] != ""))


def reject_reason(row: Column | None = None) -> Column:
    """Why a row breaks the article contract; null for a valid row.

    Reads url, content, raw_domain, date_status and content_id, of ``row`` if given.
    """

    def field(name: str) -> Column:
        return F.col(name) if row is None else row[name]

    def length(name: str) -> Column:
        return F.coalesce(F.char_length(field(name)), F.lit(0))

    host = F.regexp_extract(field("url"), r"^(?i:https?)://([^/?#]+)", 1)
    checks = [
        (F.coalesce(host, F.lit("")) == "", "url"),
        (length("url") > MAX_URL_CHARS, "url_length"),
        (length("content") < MIN_CONTENT_CHARS, "content_length"),
        (length("raw_domain") < MIN_DOMAIN_CHARS, "publisher_domain"),
        (F.coalesce(field("date_status"), F.lit("missing")) == "bad", "published_date"),
        (length("content_id") != CONTENT_ID_CHARS, "content_id"),
    ]
    return reduce(lambda acc, c: acc.when(c[0], c[1]), checks[1:], F.when(*checks[0]))


def with_reject_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason())


def valid_articles(df: DataFrame) -> DataFrame:
    return keep_computed(df, lambda row: reject_reason(row).isNull())


def rejected_articles(df: DataFrame) -> DataFrame:
    return keep_computed(with_reject_reason(df), lambda row: row["reject_reason"].isNotNull())
