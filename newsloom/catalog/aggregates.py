"""Statistics over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.admission import ADMITTED_SQL, DECIDED_SQL, decided, admitted_keys
from newsloom.catalog.fixtures import CORPUS_SQL, VECTORS_SQL, corpus, corpus_facts, seen, sql_time, time_text, vectors
from newsloom.functions.urls import normalize_url
from newsloom.operators import aggregates as ops
from newsloom.session import work_path
from newsloom.sources.tables import CorpusTable
from newsloom.streaming.rates import read_rates, write_rates
from newsloom.streaming.rates import stream_dup_rate as ops_rates


@query("total_articles", f"with {CORPUS_SQL} select count(*) as total from corpus")
def total_articles(spark, folder):
    return ops.total_articles(corpus_facts(spark, folder))


@query(
    "top_publishers",
    f"with {CORPUS_SQL} select publisher_name, count(*) as n from corpus where publisher_name is not null group by 1 order by n desc, publisher_name limit 5",
)
def top_publishers(spark, folder):
    return ops.top_publishers(corpus_facts(spark, folder))


@query("by_bucket", f"with {CORPUS_SQL} select bucket, count(*) as n from corpus where bucket is not null group by 1")
def by_bucket(spark, folder):
    return ops.by_bucket(corpus_facts(spark, folder))


@query("by_signal_type", f"with {CORPUS_SQL} select signal_type, count(*) as n from corpus where signal_type is not null group by 1")
def by_signal_type(spark, folder):
    return ops.by_signal_type(corpus_facts(spark, folder))


@query("date_range", f"with {CORPUS_SQL} select {sql_time('min(date)')} as earliest, {sql_time('max(date)')} as latest from corpus")
def date_range(spark, folder):
    return ops.date_range(corpus_facts(spark, folder)).select(
        time_text("earliest").alias("earliest"), time_text("latest").alias("latest")
    )


@query(
    "daily_timeline",
    f"""with {CORPUS_SQL} select cast(cast(date as date) as varchar) as pub_day, count(*) as n from corpus
    where date is not null group by 1 order by 1 desc limit 14""",
)
def daily_timeline(spark, folder):
    return ops.daily_timeline(corpus_facts(spark, folder)).withColumn("pub_day", F.col("pub_day").cast("string"))


@query(
    "filter_values",
    f"""with {CORPUS_SQL} select distinct 'bucket' as kind, bucket as value from corpus where bucket is not null
    union all select distinct 'signal_type', signal_type from corpus where signal_type is not null""",
)
def filter_values(spark, folder):
    return ops.filter_values(corpus_facts(spark, folder))


@query(
    "unique_publishers",
    f"""with {CORPUS_SQL} select count(distinct publisher_name) as unique_publishers,
    least(count(distinct publisher_name), 5) as top_publisher_count from corpus""",
)
def unique_publishers(spark, folder):
    return ops.unique_publishers(corpus_facts(spark, folder))


CORPUS_STATS_SQL = f"""with {CORPUS_SQL},
p as (select publisher_name as key, count(*) as n from corpus where publisher_name is not null group by 1),
d as (select cast(cast(date as date) as varchar) as key, count(*) as n from corpus where date is not null group by 1)
    select 'publisher' as section, key, n as value from (select * from p order by n desc, key limit 5)
    union all select 'day', key, n from (select * from d order by key desc limit 14)
    union all select 'bucket', bucket, count(*) from corpus where bucket is not null group by bucket
    union all select 'signal_type', signal_type, count(*) from corpus where signal_type is not null group by signal_type
    union all select 'total', 'articles', count(*) from corpus
    union all select 'total', 'unique_publishers', count(*) from p
    union all select 'date_range', 'earliest_micros', epoch_us(min(date)) from corpus
    union all select 'date_range', 'latest_micros', epoch_us(max(date)) from corpus"""


@query("corpus_stats", CORPUS_STATS_SQL)
def corpus_stats(spark, folder):
    return ops.corpus_stats(corpus_facts(spark, folder))


# Three commits that end in the corpus: a third of the rows with other facts, then two thirds, then all.
@query("kept_stats", CORPUS_STATS_SQL)
def kept_stats(spark, folder):
    table = CorpusTable(spark, work_path(spark, "stats-table"), buckets=8, stats=True)
    rows = corpus(spark, folder)
    other = (
        rows.withColumn("publisher_name", F.concat(F.lit("was "), "publisher_name"))
        .withColumn("date", F.when(F.col("seq") % 2 == 0, F.col("date") + F.expr("interval 40 days")))
        .withColumn("bucket", F.lit("all"))
    )
    table.upsert(other.where("seq % 3 = 0"))
    table.upsert(rows.where("seq % 3 <> 1"))
    table.upsert(rows)
    return table.read_stats()


@query(
    "embedding_stats",
    f"""with {VECTORS_SQL}
    select (select count(*) from vectors) as embedding_count,
           (select cast(max(len(embedding)) as bigint) from vectors) as embedding_dim,
           count(distinct content_id) as corpus_contents,
           count(distinct case when content_id in (select content_id from vectors) then content_id end) as embedded_contents,
           round(count(distinct case when content_id in (select content_id from vectors) then content_id end) / count(distinct content_id), 4) as coverage
    from corpus""",
)
def embedding_stats(spark, folder):
    return ops.embedding_stats(vectors(spark, folder), corpus_facts(spark, folder))


_RATES_SQL = f"""{DECIDED_SQL},
rates as (
  select bucket, page, sum(cast(accepted as int)) as accepted, sum(1 - cast(accepted as int)) as rejected,
         sum(1 - cast(accepted as int)) / count(*) as dup_rate
  from decided group by bucket, page
)"""


@query(
    "page_dup_rate",
    f"with {_RATES_SQL} select bucket, page, cast(accepted as bigint) as accepted, cast(rejected as bigint) as rejected, round(dup_rate, 6) as dup_rate from rates",
)
def page_dup_rate(spark, folder):
    rates = ops.page_dup_rate(decided(spark, folder))
    return rates.withColumn("dup_rate", F.round("dup_rate", 6))


ROLLING_SQL = f"""with {_RATES_SQL},
w as (select *, avg(dup_rate) over last4 as m, count(*) over last4 as window_size from rates
      window last4 as (partition by bucket order by page rows between 3 preceding and current row))
select bucket, page, round(dup_rate, 6) as dup_rate, round(m, 6) as mean_dup_rate, window_size,
       window_size = 4 and m > 0.6 as flagged from w"""


@query("rolling_dup_rate", ROLLING_SQL)
def rolling_dup_rate(spark, folder):
    rates = ops.rolling_dup_rate(ops.page_dup_rate(decided(spark, folder)))
    return rates.withColumn("dup_rate", F.round("dup_rate", 6)).withColumn("mean_dup_rate", F.round("mean_dup_rate", 6))


@query("stream_dup_rate", ROLLING_SQL)
def stream_dup_rate(spark, folder):
    landing, out = work_path(spark, "decided"), work_path(spark, "rates")
    items = decided(spark, folder).select("bucket", F.col("page").cast("bigint").alias("page"), "accepted")
    items.repartitionByRange(6, "page").write.parquet(landing)
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    write_rates(ops_rates(source), out, work_path(spark, "rates-checkpoint")).awaitTermination()
    rates = read_rates(spark, out)
    return rates.withColumn("dup_rate", F.round("dup_rate", 6)).withColumn("mean_dup_rate", F.round("mean_dup_rate", 6))


@query(
    "discovery_summary",
    f"""with {ADMITTED_SQL}
    select 'bucket' as kind, bucket, count(*) as n from admitted group by bucket
    union all select 'total', null, count(*) from admitted
    union all select 'seeds', null, count(distinct url_norm) from known""",
)
def discovery_summary(spark, folder):
    seeds = seen(spark, folder).select(normalize_url(F.col("url")).alias("url_norm"))
    return ops.discovery_summary(admitted_keys(spark, folder), seeds)
