"""Filters over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.fixtures import (
    ARTICLES_SQL,
    CORPUS_SQL,
    DISCOVERED_SQL,
    VECTORS_SQL,
    articles,
    corpus,
    corpus_facts,
    discovered,
    vectors,
)
from newsloom.functions import urls
from newsloom.operators import filters as ops
from newsloom.operators.admission import candidate_keys
from newsloom.operators.joins import hydrate_hits
from newsloom.operators.similarity import with_similarity

QUERY_VECTOR_SQL = "(select embedding from vectors where vec_id = 0)"
SIMILARITY_SQL = f"list_cosine_similarity(embedding, {QUERY_VECTOR_SQL})"


def query_vector(vecs) -> list[float]:
    """The stored vector used as the query."""
    return list(vecs.where("vec_id = 0").first()["embedding"])


@query("filter_bucket_signal", f"with {CORPUS_SQL} select url from corpus where bucket = 'en' and signal_type = 'trends'")
def filter_bucket_signal(spark, folder):
    return ops.filter_bucket_signal(corpus_facts(spark, folder), "en", "trends").select("url")


@query("filter_publisher", f"with {CORPUS_SQL} select url from corpus where lower(publisher_name) like '%rc1%'")
def filter_publisher(spark, folder):
    return ops.filter_publisher(corpus_facts(spark, folder), "RC1").select("url")


@query(
    "filter_date_range",
    f"with {CORPUS_SQL} select url from corpus where date >= timestamp '2024-01-05' and date < timestamp '2024-01-13'",
)
def filter_date_range(spark, folder):
    return ops.filter_date_range(corpus_facts(spark, folder), "2024-01-05", "2024-01-12").select("url")


@query(
    "keyword_match",
    f"with {CORPUS_SQL} select url from corpus where lower(title) like '%tion%the%' or lower(content) like '%tion%the%'",
)
def keyword_match(spark, folder):
    return ops.keyword_match(corpus(spark, folder), "TION%the").select("url")


_HOST = "regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)"
_SHAPED_SQL = f"""{ARTICLES_SQL},
shaped as (
  select seq, case when seq % 13 = 5 then 'ftp' || substr(url, 6) when seq % 13 = 6 then 'http://x/' || seq else url end as url,
         case when seq % 11 = 3 then substr(content, 1, 9) else content end as content,
         case when seq % 29 = 1 then 'bad' else 'ok' end as date_status,
         case when seq % 31 = 2 then '' else content_id end as content_id
  from articles
),
judged as (
  select seq, case when {_HOST} = '' then 'url' when length(url) > 2083 then 'url_length'
       when length(content) < 10 then 'content_length' when length(regexp_extract(url, '://([^/?#]*)', 1)) < 3 then 'publisher_domain'
       when date_status = 'bad' then 'published_date' when length(content_id) <> 40 then 'content_id' end as reject_reason
  from shaped
)"""


def _shaped(spark, folder):
    seq = F.col("seq")
    url = (
        F.when(seq % 13 == 5, F.concat(F.lit("ftp"), F.substr("url", F.lit(6))))
        .when(seq % 13 == 6, F.concat(F.lit("http://x/"), seq.cast("string")))
        .otherwise(F.col("url"))
    )
    rows = articles(spark, folder).select(
        "seq", url.alias("url"),
        F.when(seq % 11 == 3, F.substring("content", 1, 9)).otherwise(F.col("content")).alias("content"),
        F.when(seq % 29 == 1, "bad").otherwise("ok").alias("date_status"),
        F.when(seq % 31 == 2, F.lit("")).otherwise(F.col("content_id")).alias("content_id"),
    )
    return rows.withColumn("raw_domain", urls.raw_domain(F.lit(None).cast("string"), F.col("url")))


@query("valid_article", f"with {_SHAPED_SQL} select seq, reject_reason from judged")
def valid_article(spark, folder):
    return ops.with_reject_reason(_shaped(spark, folder)).select("seq", "reject_reason")


@query(
    "min_similarity",
    f"""with {VECTORS_SQL}, hits as (select content_id, {SIMILARITY_SQL} as s from vectors)
    select content_id, round(s, 4) as similarity from hits where not isnan(s) and s >= 0.1""",
)
def min_similarity(spark, folder):
    vecs = vectors(spark, folder)
    scored = with_similarity(vecs, query_vector(vecs))
    return ops.min_similarity(scored, 0.1).select("content_id", F.round("similarity", 4).alias("similarity"))


@query(
    "post_filter_hits",
    f"""with {VECTORS_SQL}
    select v.content_id, c.bucket, c.signal_type from vectors v join corpus c on v.content_id = c.content_id
    where (c.league = 'serie_a' or c.bucket = 'serie_a') and c.signal_type = 'trends'""",
)
def post_filter_hits(spark, folder):
    vecs = vectors(spark, folder).select("content_id", "url", "title")
    hydrated = hydrate_hits(vecs, corpus_facts(spark, folder), rows=1 << 40)
    return ops.post_filter_hits(hydrated, "serie_a", "trends").select("content_id", "bucket", "signal_type")


@query(
    "filter_articles",
    f"""with {CORPUS_SQL} select url from corpus where league = 'serie_a' and signal_type = 'trends'
      and date >= timestamp '2024-01-02' and date < timestamp '2024-01-21'""",
)
def filter_articles(spark, folder):
    return ops.filter_articles(
        corpus_facts(spark, folder), league="serie_a", signal_type="trends", date_from="2024-01-02",
        date_to="2024-01-20", date_column="date",
    ).select("url")


@query(
    "admissible_url",
    f"with {DISCOVERED_SQL} select bucket, page, pos from hosts where url_norm <> '' and domain <> ''",
)
def admissible_url(spark, folder):
    return ops.admissible_url(candidate_keys(discovered(spark, folder))).select("bucket", "page", "pos")
