"""The corpus tables derived from the given tables, whole, in Spark and in SQL.

documents -> articles -> corpus; embeddings -> vectors; pages -> discovered items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import TRANSFER_TERMS, TREND_TERMS
from newsloom.functions import text, topics
from newsloom.functions.binding import keep_computed
from newsloom.functions.text import WHITESPACE
from newsloom.session import spread, work_path

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def time_text(column):
    return F.date_format(column, TIME_FORMAT)


def sql_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and input folder, then read.

    The corpus is a stored table that queries scan; this is what lets their filters and
    column choices reach the files.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:
            pass  # the working folder was emptied: write the table again
    _STORED[key] = work_path(spark, name)
    build().write.parquet(_STORED[key])
    return spark.read.parquet(_STORED[key])


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as far as their document tells. Written where the texts are read: none moves."""
    return stored(spark, folder, "texts", lambda: shape_texts(table(spark, folder, "documents")).drop("text"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Read with the columns asked for: contents move to their events only where they are."""
    return with_events(texts(spark, folder), events_by_seq(table(spark, folder, "events")))


def shape_articles(docs: DataFrame, raw_events: DataFrame) -> DataFrame:
    return with_events(shape_texts(docs), events_by_seq(raw_events))


def shape_texts(docs: DataFrame) -> DataFrame:
    base = docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("publisher_name"),
        text.normalize_text(F.col("text")).alias("content"),
        F.col("lang").alias("bucket"),
        F.when(F.col("lang") == "es", "la_liga").when(F.col("lang") == "de", "serie_a").alias("league"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("source_feed"),
        "text",
    )
    base = keep_computed(base, lambda row: F.char_length(row["content"]) >= 10)
    titled = base.withColumn("content_id", F.sha1("content")).withColumn("title", F.substring("content", 1, 80))
    return titled.withColumn("signal", topics.signal_parts(F.col("title"), F.col("content"), F.col("bucket")))


def events_by_seq(raw_events: DataFrame) -> DataFrame:
    """The events of documents: those with ten times a document's id."""
    return raw_events.where(F.col("event_id") % 10 == 0).select(
        F.expr("event_id div 10").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )


def with_events(rows: DataFrame, events: DataFrame, how: str = "left") -> DataFrame:
    """``shape_texts`` rows as articles; joined on ``seq``, by which their later joins go too."""
    joined = rows.join(events, "seq", how)
    known = {
        "date": F.when(F.col("seq") % 17 != 0, F.col("ts")),
        "source_type": F.col("event_type"),
        "signal_type": topics.signal_with(F.col("signal"), F.col("event_type")),
    }
    order = (
        "seq", "url", "publisher_name", "date", "content", "bucket", "league", "source_type", "source_feed", "text",
        "content_id", "title", "signal_type",
    )
    return joined.select(*[known[c].alias(c) if c in known else F.col(c) for c in order if c in known or c in rows.columns])


def _pattern(terms: tuple[str, ...]) -> str:
    return "|".join(terms)


SIGNAL_TEXT = "lower(title || ' ' || content || ' ' || concat_ws(' ', bucket, source_type))"
SIGNAL_SQL = (
    f"case when regexp_matches({SIGNAL_TEXT}, '{_pattern(TRANSFER_TERMS)}') then 'transfers' "
    f"when regexp_matches({SIGNAL_TEXT}, '{_pattern(TREND_TERMS)}') then 'trends' else 'general_news' end"
)

ARTICLES_SQL = f"""
base as (
  select d.doc_id as seq, 'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id as url,
         d.source as publisher_name, case when d.doc_id % 17 <> 0 then e.ts end as date,
         trim(regexp_replace(d.text, '{WHITESPACE}', ' ', 'g')) as content, d.lang as bucket,
         case d.lang when 'es' then 'la_liga' when 'de' then 'serie_a' end as league,
         e.event_type as source_type, 'https://' || d.source || '.example.com/feed' as source_feed,
         d.text as text
  from documents d left join events e on e.event_id = d.doc_id * 10
),
titled as (
  select *, sha1(content) as content_id, substr(content, 1, 80) as title from base where length(content) >= 10
),
articles as (select *, {SIGNAL_SQL} as signal_type from titled)"""


def _first(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, ts, event_type) of the corpus' rows: the first in sequence of each content."""

    def build() -> DataFrame:
        first = texts(spark, folder).groupBy("content_id").agg(F.min("seq").alias("seq")).select("seq").distinct()
        return first.join(events_by_seq(table(spark, folder, "events")), "seq", "left")

    return stored(spark, folder, "first", build)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One article per content: the first in sequence. Chosen on narrow keys.

    Files are sorted by date, so date filters skip row groups.
    """

    def build() -> DataFrame:
        return with_events(texts(spark, folder), _first(spark, folder), "inner").sortWithinPartitions("date")

    return stored(spark, folder, "corpus", build)


def corpus_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without its contents, for queries that read none: contents stay where they are."""

    def build() -> DataFrame:
        rows = texts(spark, folder).drop("content")
        return with_events(rows, _first(spark, folder), "inner").sortWithinPartitions("date")

    return stored(spark, folder, "facts", build)


CORPUS_SQL = ARTICLES_SQL + """,
corpus as (
  select * exclude (text) from articles
  where seq in (select min(seq) from articles group by content_id)
)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings filed under the content id of their article; others stay without one."""

    def build() -> DataFrame:
        meta = corpus_facts(spark, folder).select("seq", "content_id", "url", "title")
        joined = table(spark, folder, "embeddings").join(meta, F.col("vec_id") == F.col("seq"), "left")
        own_id = F.sha1(F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
        shown = F.when(F.col("vec_id") % 3 == 0, F.lit("")).otherwise(F.coalesce("url", F.lit("")))
        return joined.select(
            "vec_id",
            F.coalesce("content_id", own_id).alias("content_id"),
            shown.alias("url"),
            F.when(F.col("vec_id") % 2 == 0, F.col("title")).alias("title"),
            "embedding",
            "label",
        )

    return stored(spark, folder, "vectors", build)


VECTORS_SQL = CORPUS_SQL + """,
vectors as (
  select e.vec_id, coalesce(c.content_id, sha1('vector ' || e.vec_id)) as content_id,
         case when e.vec_id % 3 = 0 then '' else coalesce(c.url, '') end as url,
         case when e.vec_id % 2 = 0 then c.title end as title,
         cast(e.embedding as double[]) as embedding, e.label
  from embeddings e left join corpus c on e.vec_id = c.seq
)"""


BUCKETS = ("de", "en", "es", "fr")
PAGE_ITEMS = 50


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """Every page URL offered twice: once as found, once in another spelling.

    The second offer comes a page later, for some hosts in the next bucket.
    """
    pages = table(spark, folder, "pages").withColumn("second", F.explode(F.array(F.lit(0), F.lit(1))))
    host = F.regexp_extract("url", "://([^/]*)/", 1)
    own = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1)) - 1
    moved = (F.col("second") == 1) & (F.char_length(host) % 3 == 0)
    pos = F.when(moved, (own + 1) % len(BUCKETS)).otherwise(own).cast("int")
    spelled = F.when(F.col("second") == 0, F.col("url")).otherwise(
        F.concat(F.replace(F.col("url"), host, F.upper(host)), F.lit("#again"))
    )
    return pages.select(
        spelled.alias("url"),
        F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), pos + 1).alias("bucket"),
        pos.alias("bucket_pos"),
        (F.floor(F.col("page_id") / PAGE_ITEMS) * 2 + F.col("second")).cast("bigint").alias("page"),
        F.col("page_id").alias("pos"),
        F.col("url").alias("page_url"),
    )


def seen(spark: SparkSession, folder: str) -> DataFrame:
    """URLs persisted earlier: the pages that came through a feed link."""
    return table(spark, folder, "pages").where(F.contains("url", F.lit("utm_source=feed"))).select("url")


_BUCKET_LIST = "[" + ", ".join(f"'{b}'" for b in BUCKETS) + "]"

# Normalized form of the page URLs, which hold no percent escapes.
PARTS_SQL = "'^([^:]*)://([^/?#]*)([^?#]*)([?]([^#]*))?(#.*)?$'"


def sql_normalized(url: str) -> str:
    from newsloom.config import TRACKING_PARAMS

    dropped = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)
    host = f"lower(regexp_extract({url}, {PARTS_SQL}, 2))"
    path = f"regexp_extract({url}, {PARTS_SQL}, 3)"
    pieces = f"string_split(regexp_extract({url}, {PARTS_SQL}, 5), '&')"
    kept = f"list_sort(list_filter({pieces}, lambda p: p <> '' and string_split(p, '=')[1] not in ({dropped})))"
    return (
        f"lower(regexp_extract({url}, {PARTS_SQL}, 1)) || '://' || {host} || "
        f"case when {path} = '' then '/' else {path} end || "
        f"case when len({kept}) = 0 then '' else '?' || array_to_string({kept}, '&') end"
    )


DISCOVERED_SQL = f"""
offered as (
  select *, regexp_extract(url, '://([^/]*)/', 1) as host,
         list_position({_BUCKET_LIST}, regexp_extract(url, '://[^/]*/([^/?#]*)', 1)) - 1 as own
  from pages, (values (0), (1)) as s(second)
),
placed as (
  select *, case when second = 1 and length(host) % 3 = 0 then (own + 1) % {len(BUCKETS)} else own end as bpos from offered
),
discovered as (
  select case when second = 0 then url else replace(url, host, upper(host)) || '#again' end as url,
         {_BUCKET_LIST}[bpos + 1] as bucket, bpos as bucket_pos,
         (page_id // {PAGE_ITEMS}) * 2 + second as page, page_id as pos, url as page_url
  from placed
),
seen as (select url from pages where contains(url, 'utm_source=feed')),
keys as (select *, {sql_normalized('url')} as url_norm from discovered),
hosts as (select *, lower(regexp_extract(url_norm, '://([^/?#]*)', 1)) as domain from keys)"""
