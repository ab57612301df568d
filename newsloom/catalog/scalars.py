"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.fixtures import (
    ARTICLES_SQL,
    CORPUS_SQL,
    DISCOVERED_SQL,
    articles,
    corpus,
    discovered,
    sql_time,
    table,
    time_text,
)
from newsloom.config import FOOTBALL_TERMS, TOPICS
from newsloom.functions import dates, text, topics, urls
from newsloom.functions.text import WHITESPACE
from newsloom.operators.joins import attribute_topic
from newsloom.operators.search import article_projection

_KEYS = [t[0] for t in TOPICS]
_KEY_SQL = "[" + ", ".join(f"'{k}'" for k in _KEYS) + "]"


@query("normalize_url", f"with {DISCOVERED_SQL} select bucket, page, pos, url_norm from hosts")
def normalize_url(spark, folder):
    return discovered(spark, folder).select("bucket", "page", "pos", urls.normalize_url(F.col("url")).alias("url_norm"))


@query("url_domain", f"with {DISCOVERED_SQL} select bucket, page, pos, lower(regexp_extract(url, '://([^/?#]*)', 1)) as domain from discovered")
def url_domain(spark, folder):
    return discovered(spark, folder).select("bucket", "page", "pos", urls.url_domain(F.col("url")).alias("domain"))


@query(
    "publisher_domain",
    f"""with {DISCOVERED_SQL}
    select bucket, page, pos,
           regexp_replace(lower(case when pos % 5 = 0 then ' WWW.Given-' || bucket || '.ORG ' else regexp_extract(url, '://([^/?#]*)', 1) end).trim(), '^www[.]', '') as publisher_domain
    from discovered""",
)
def publisher_domain(spark, folder):
    given = F.when(F.col("pos") % 5 == 0, F.concat(F.lit(" WWW.Given-"), "bucket", F.lit(".ORG ")))
    return discovered(spark, folder).select(
        "bucket", "page", "pos", urls.publisher_domain(given, F.col("url")).alias("publisher_domain")
    )


@query(
    "normalize_text",
    f"select doc_id, trim(regexp_replace(text, '{WHITESPACE}', ' ', 'g')) as content from documents",
)
def normalize_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("content"))


@query(
    "content_id",
    f"select doc_id, sha1(trim(regexp_replace(text, '{WHITESPACE}', ' ', 'g'))) as content_id from documents",
)
def content_id(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.content_id(F.col("text")).alias("content_id"))


@query(
    "extracted_length",
    f"select doc_id, length(trim(regexp_replace(text, '{WHITESPACE}', ' ', 'g'))) as extracted_content_length from documents",
)
def extracted_length(spark, folder):
    length = F.char_length(text.normalize_text(F.col("text"))).cast("bigint")
    return table(spark, folder, "documents").select("doc_id", length.alias("extracted_content_length"))


@query("classify_signal", f"with {ARTICLES_SQL} select seq, signal_type from articles")
def classify_signal(spark, folder):
    fresh = topics.classify_signal(F.col("title"), F.col("content"), F.array("bucket", "source_type"))
    return articles(spark, folder).select("seq", fresh.alias("signal_type"))


_TOPIC_TEXT = "lower(concat_ws(' ', title, content, content, publisher_name, bucket))"


@query(
    "is_topic_article",
    f"""with {ARTICLES_SQL}
    select seq, (coalesce(league, bucket) in ('premier_league', 'serie_a', 'la_liga')
      or regexp_matches({_TOPIC_TEXT}, '{"|".join(FOOTBALL_TERMS)}')) as is_topic from articles""",
)
def is_topic_article(spark, folder):
    check = topics.is_topic_article(
        F.col("league"), F.col("bucket"), F.col("title"), F.col("content"), F.col("content"),
        F.col("publisher_name"), F.array("bucket"),
    )
    return articles(spark, folder).select("seq", check.alias("is_topic"))


@query(
    "league_label",
    f"""with {ARTICLES_SQL}
    select seq, case league when 'serie_a' then 'Serie A' when 'la_liga' then 'La Liga' end as label from articles""",
)
def league_label(spark, folder):
    return articles(spark, folder).select("seq", topics.league_label(F.col("league")).alias("label"))


@query(
    "attribute_topic",
    f"""with t as (select doc_id, {_KEY_SQL}[cast(doc_id % 5 as int) + 1] as k from documents)
    select doc_id, case when k in ('finance', 'technology') then k else 'football' end as bucket,
           case when k not in ('finance', 'technology') then k end as league from t""",
)
def attribute(spark, folder):
    keys = F.array(*[F.lit(k) for k in _KEYS])
    items = table(spark, folder, "documents").select(
        "doc_id", F.get(keys, (F.col("doc_id") % 5).cast("int")).alias("bucket"), F.lit(None).cast("string").alias("league")
    )
    return attribute_topic(items).select("doc_id", "bucket", "league")


# Event times written the ways feeds write dates, by row.
_FEED_DATE = (
    "case event_id % 11 when 0 then {mail} || ' GMT' when 1 then {mail} || ' +0200' when 2 then {mail} || ' EST' "
    "when 3 then {iso} || 'Z' when 4 then 'soon ' || event_type when 6 then {mail} || ' +0000 (UTC)' "
    "when 7 then {short} || ' UT' when 8 then {bare} || ' GMT' when 9 then {hyphens} || ' GMT' when 10 then {long} || ' GMT' end"
)
_FEED_DATE_SQL = _FEED_DATE.format(
    mail="strftime(ts, '%a, %d %b %Y %H:%M:%S')", iso="strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    short="strftime(ts, '%A, %-d %b %y %H:%M:%S')", bare="strftime(ts, '%a %d %b %Y %H:%M:%S')",
    hyphens="strftime(ts, '%d-%b-%Y %H:%M:%S')", long="strftime(ts, '%a, %-d %B %Y %H:%M:%S')",
)


@query(
    "parse_feed_date",
    f"""select event_id, {_FEED_DATE_SQL} as raw,
           strftime(date_trunc('second', ts) + case event_id % 11 when 1 then interval (-2) hour when 2 then interval 5 hour else interval 0 hour end,
                    '%Y-%m-%d %H:%M:%S.%f') as parsed_if_ok,
           'ok' as date_status
    from events where event_id % 11 not in (4, 5)
    union all
    select event_id, {_FEED_DATE_SQL}, null, case event_id % 11 when 4 then 'bad' else 'missing' end
    from events where event_id % 11 in (4, 5)""",
)
def parse_feed_date(spark, folder):
    raw = F.expr(
        _FEED_DATE.format(
            mail="date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss')", iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
            short="date_format(ts, 'EEEE, d MMM yy HH:mm:ss')", bare="date_format(ts, 'EEE dd MMM yyyy HH:mm:ss')",
            hyphens="date_format(ts, 'dd-MMM-yyyy HH:mm:ss')", long="date_format(ts, 'EEE, d MMMM yyyy HH:mm:ss')",
        )
    )
    parsed = dates.parse_feed_date(F.col("raw"))
    return table(spark, folder, "events").select("event_id", raw.alias("raw")).select(
        "event_id", "raw", time_text(parsed).alias("parsed_if_ok"), dates.date_status(F.col("raw"), parsed).alias("date_status")
    )


_BOUND = (
    "case event_id % 5 when 0 then {day} when 1 then {iso} || 'Z' when 2 then {iso} || '+02:00' "
    "when 3 then '   ' else 'no date ' || event_type end"
)


@query(
    "parse_query_date",
    """select event_id, strftime(case event_id % 5 when 0 then date_trunc('day', ts) when 1 then date_trunc('second', ts)
           when 2 then date_trunc('second', ts) - interval 2 hour end, '%Y-%m-%d %H:%M:%S.%f') as bound from events""",
)
def parse_query_date(spark, folder):
    raw = F.expr(_BOUND.format(day="date_format(ts, 'yyyy-MM-dd')", iso="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"))
    return table(spark, folder, "events").select("event_id", time_text(dates.parse_query_date(raw)).alias("bound"))


@query(
    "as_string_list",
    """select event_id, case event_id % 4 when 0 then '' when 1 then event_type when 2 then event_type || '|' || user_id
           else '' end as joined,
           case event_id % 4 when 1 then 1 when 2 then 2 else 0 end as n from events""",
)
def as_string_list(spark, folder):
    raw = F.expr(
        "case event_id % 4 when 0 then 'null' when 1 then to_json(named_struct('v', event_type)) "
        "when 2 then concat('{\"v\":[\"', event_type, '\",null,', user_id, ']}') else '{}' end"
    )
    value = F.variant_get(F.try_parse_json(raw), "$.v", "variant")
    listed = text.string_list(value)
    return table(spark, folder, "events").select(
        "event_id", F.array_join(listed, "|").alias("joined"), F.size(listed).alias("n")
    )


@query(
    "safe_int",
    """select event_id, case event_id % 4 when 0 then cast(user_id as int) when 1 then cast(-user_id as int) end as n from events""",
)
def safe_int(spark, folder):
    raw = F.expr(
        "case event_id % 4 when 0 then concat(' ', user_id, ' ') when 1 then concat('-', user_id) "
        "when 2 then concat(user_id, '.5') else event_type end"
    )
    return table(spark, folder, "events").select("event_id", text.safe_int(raw).alias("n"))


@query(
    "embedding_text",
    f"""with {ARTICLES_SQL}
    select seq, concat_ws('. ', nullif(case when seq % 4 = 0 then '' else trim(title) end, ''), trim(content)) as embedding_text from articles""",
)
def embedding_text(spark, folder):
    title = F.when(F.col("seq") % 4 == 0, F.lit("  ")).otherwise(F.col("title"))
    return articles(spark, folder).select("seq", text.embedding_text(title, F.col("content")).alias("embedding_text"))


@query(
    "snippet",
    f"""with {ARTICLES_SQL}
    select seq, case when length(content) > 500 then substr(content, 1, 500) || '...' else content end as snippet from articles""",
)
def snippet(spark, folder):
    return articles(spark, folder).select("seq", text.snippet(F.col("content")).alias("snippet"))


@query(
    "choose_content",
    f"""with {ARTICLES_SQL}
    select seq, case when seq % 3 = 0 then title when seq % 3 = 1 then coalesce(title, '') else content end as chosen from articles""",
)
def choose_content(spark, folder):
    paywall = F.when(F.col("seq") % 3 == 0, True).when(F.col("seq") % 2 == 0, False)
    extracted = F.when(F.col("seq") % 3 == 1, F.lit("")).otherwise(F.col("content"))
    return articles(spark, folder).select(
        "seq", text.choose_content(paywall, extracted, F.col("title")).alias("chosen")
    )


@query(
    "stamp_crawl",
    f"""with {ARTICLES_SQL} select seq, '2026-01-02 03:04:05.000000' as crawl_ts from articles""",
)
def stamp_crawl(spark, folder):
    from newsloom.plans.ingest import stamp

    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    return stamp(articles(spark, folder), at).select("seq", time_text("crawl_ts").alias("crawl_ts"))


@query(
    "result_projection",
    f"""with {CORPUS_SQL}
    select url, title, case when length(content) > 500 then substr(content, 1, 500) || '...' else content end as content,
           publisher_name, {sql_time('date')} as published_date, content_id, bucket, signal_type, source_type, source_feed
    from corpus""",
)
def result_projection(spark, folder):
    shaped = article_projection(corpus(spark, folder), truncate=True)
    return shaped.withColumn("published_date", time_text("published_date"))
