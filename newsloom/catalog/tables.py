"""Sinks, upserts and streams, run over whole tables and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.catalog import query
from newsloom.catalog.admission import ADMITTED_SQL, QUOTA
from newsloom.catalog.fixtures import (
    ARTICLES_SQL,
    BUCKETS,
    CORPUS_SQL,
    DISCOVERED_SQL,
    VECTORS_SQL,
    articles,
    corpus,
    discovered,
    seen,
    shape_articles,
    sql_time,
    table,
    time_text,
    vectors,
)
from newsloom.catalog.joins import sql_page_text
from newsloom.functions.text import content_id
from newsloom.operators.admission import admit_static, visit_order
from newsloom.operators.upsert import upsert_corpus, upsert_vectors
from newsloom.operators.filters import rejected_articles, valid_articles
from newsloom.plans.ingest import shaped_articles, to_articles, to_corpus_batch, with_page_text
from newsloom.schemas import CORPUS, DISCOVERED, VECTORS
from newsloom.session import materialize, work_path
from newsloom.sources import files
from newsloom.sources.tables import CorpusTable, publish_snapshot, read_snapshot
from newsloom.sources.union import align_schema
from newsloom.streaming.ingest import dedup_against_corpus, dedup_stream, file_stream, ingest_stream, known_urls

ITEMS = T.StructType(list(DISCOVERED.fields)).add("bucket", T.StringType()).add("seq", T.LongType())
STAMP = "2026-01-02 00:00:00"


def _stamped(rows):
    return align_schema(rows.withColumn("inserted_at", F.lit(STAMP).cast("timestamp")), CORPUS)


def stored_corpus(spark, folder) -> str:
    path = work_path(spark, "corpus")
    _stamped(corpus(spark, folder)).write.parquet(path)
    return path


@query(
    "read_vectors",
    f"with {VECTORS_SQL} select content_id, url, title, len(embedding) as dim, round(list_sum(embedding), 3) as total from vectors",
)
def read_vectors(spark, folder):
    path = work_path(spark, "vectors")
    rows = vectors(spark, folder).withColumn("embedded_at", F.lit(STAMP).cast("timestamp"))
    align_schema(rows, VECTORS).write.parquet(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return files.read_vectors(spark, path).select(
        "content_id", "url", "title", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 3).alias("total")
    )


@query(
    "write_jsonl",
    f"with {CORPUS_SQL} select url, title, content, content_id, {sql_time('date')} as date from corpus",
)
def write_jsonl(spark, folder):
    path = work_path(spark, "jsonl")
    files.write_jsonl(_stamped(corpus(spark, folder)), path)
    back = files.read_jsonl(spark, path, CORPUS)
    return back.select("url", "title", "content", "content_id", time_text("date").alias("date"))


@query("write_parquet", f"with {CORPUS_SQL} select url, title, content_id, signal_type from corpus where bucket is not null")
def write_parquet(spark, folder):
    root = work_path(spark, "snapshot")
    rows = _stamped(corpus(spark, folder))
    publish_snapshot(rows.select("url"), root)
    publish_snapshot(rows, root)
    return read_snapshot(spark, root).select("url", "title", "content_id", "signal_type")


@query(
    "align_schema",
    f"with {ARTICLES_SQL} select url, content_id, null::varchar as league, null::varchar as source_feed, title from articles",
)
def align(spark, folder):
    old = articles(spark, folder).select("url", "content_id", "title")
    return align_schema(old, CORPUS).select("url", "content_id", "league", "source_feed", "title")


def _second_batch(spark, folder):
    """A re-crawl: a third of the articles updated, a third offered under another URL, a
    third edited, after which a mirror offers the old text of the edited ones."""
    rows = articles(spark, folder).drop("text")
    kind = F.col("seq") % 3
    changed = (
        rows.withColumn("title", F.when(kind == 0, F.concat(F.lit("updated "), "title")).otherwise(F.col("title")))
        .withColumn("url", F.when(kind == 1, F.concat("url", F.lit("/v2"))).otherwise(F.col("url")))
        .withColumn(
            "content",
            F.when(kind == 2, F.concat("content", F.lit(" edited "), F.col("seq").cast("string"))).otherwise(F.col("content")),
        )
        .withColumn("content_id", content_id(F.col("content")))
    )
    mirrors = rows.where(kind == 2).withColumn("url", F.concat("url", F.lit("/mirror"))).withColumn(
        "seq", F.col("seq") + F.lit(1 << 40)
    )
    return materialize(changed.unionByName(mirrors), "second-batch")


_UPSERTED_SQL = f"""{CORPUS_SQL},
kept as (
  select url, content_id, case when seq % 3 = 0 then 'updated ' || title else title end as title, true as old
  from corpus where seq % 3 <> 2
),
edited as (
  select url, sha1(content || ' edited ' || seq) as content_id, title, seq in (select seq from corpus) as old
  from articles where seq % 3 = 2
),
takers as (
  select content_id, min(seq) as seq from articles where seq % 3 <> 2 group by content_id
),
freed as (
  select case when a.seq is null then c.url || '/mirror' when a.seq % 3 = 1 then a.url || '/v2' else a.url end as url,
         c.content_id, case when a.seq is null then c.title when a.seq % 3 = 0 then 'updated ' || a.title else a.title end as title,
         false as old
  from corpus c left join takers t on t.content_id = c.content_id left join articles a on a.seq = t.seq
  where c.seq % 3 = 2
)"""


@query(
    "upsert_corpus",
    f"with {_UPSERTED_SQL} select * from kept union all select * from edited union all select * from freed",
)
def upsert(spark, folder):
    at = F.lit("2026-02-02 00:00:00").cast("timestamp")
    after = upsert_corpus(_stamped(corpus(spark, folder)), _second_batch(spark, folder), at)
    return after.select("url", "content_id", "title", (F.col("inserted_at") < at).alias("old"))


@query(
    "corpus_table",
    f"with {_UPSERTED_SQL} select * from kept union all select * from edited union all select * from freed",
)
def corpus_table(spark, folder):
    store = CorpusTable(spark, work_path(spark, "table"), buckets=8)
    first, at = F.lit(STAMP).cast("timestamp"), F.lit("2026-02-02 00:00:00").cast("timestamp")
    store.upsert(articles(spark, folder).drop("text"), tag="one", batch_ts=first)
    second = _second_batch(spark, folder)
    for _ in range(2):  # the repeated delivery changes nothing
        store.upsert(second, tag="two", batch_ts=at)
    return store.read().select("url", "content_id", "title", (F.col("inserted_at") < at).alias("old"))


@query(
    "upsert_vectors",
    f"""with {VECTORS_SQL}
    select content_id, url, title, round(embedding[1], 4) as head, label % 2 = 0 as fresh from
      (select content_id, url, title, case when label % 2 = 0 then list_reverse(embedding) else embedding end as embedding, label from vectors)
    union all
    select sha1('new ' || content_id), 'first', title, round(embedding[64], 4), true from vectors where label % 2 = 1""",
)
def upsert_vecs(spark, folder):
    old_at, new_at = F.lit(STAMP).cast("timestamp"), F.lit("2026-02-02 00:00:00").cast("timestamp")
    stored = vectors(spark, folder)
    existing = stored.select("content_id", "url", "title", "embedding", old_at.alias("embedded_at"))
    even = F.col("label") % 2 == 0
    offers = stored.select(
        F.when(even, F.col("content_id")).otherwise(F.sha1(F.concat(F.lit("new "), "content_id"))).alias("content_id"),
        "title", "embedding",
    )
    first = offers.select(F.lit(1).alias("seq"), "content_id", F.lit("first").alias("url"), "title", "embedding", new_at.alias("embedded_at"))
    again = offers.select(
        F.lit(2).alias("seq"), "content_id", F.lit("second").alias("url"), F.lit("other").alias("title"),
        F.reverse("embedding").alias("embedding"), new_at.alias("embedded_at"),
    )
    after = upsert_vectors(existing, first.unionByName(again))
    return after.select(
        "content_id", "url", "title", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("head"),
        (F.col("embedded_at") == new_at).alias("fresh"),
    )


def _document_stream(spark, folder):
    schema = table(spark, folder, "documents").schema
    # A pattern rather than a name: the table may be one file or a folder of files.
    return file_stream(spark, f"{folder}/documents.parque[t]", schema)


# Two streams into one table, English first; a content belongs to the first that brings it.
@query(
    "ingest_stream",
    f"""with {ARTICLES_SQL},
    placed as (select *, row_number() over (partition by content_id order by bucket <> 'en', seq) as place from articles)
    select url, content_id, title, signal_type, {sql_time('date')} as date from placed where place = 1""",
)
def stream(spark, folder):
    store = CorpusTable(spark, work_path(spark, "stream-table"), buckets=8)
    events = table(spark, folder, "events")
    for name, own in (("english", F.col("lang") == "en"), ("others", F.col("lang") != "en")):
        run = ingest_stream(
            _document_stream(spark, folder).where(own), store, name, work_path(spark, "stream-checkpoint"),
            lambda batch: shape_articles(batch, events).drop("text"), jsonl_path=work_path(spark, "stream-jsonl"),
        )
        run.awaitTermination()
    return store.read().select("url", "content_id", "title", "signal_type", time_text("date").alias("date"))


@query("stream_dedup", f"with {DISCOVERED_SQL} select distinct url_norm from hosts")
def stream_dedup(spark, folder):
    landing, out = work_path(spark, "items"), work_path(spark, "deduped")
    items = discovered(spark, folder)
    items.write.parquet(landing)
    source = spark.readStream.schema(items.schema).format("parquet").option("maxFilesPerTrigger", 2).load(landing)
    run = (
        dedup_stream(source).writeStream.format("parquet").option("checkpointLocation", work_path(spark, "dedup-checkpoint"))
        .option("path", out).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("url_norm")


# Every URL comes twice, a page apart: within the delay, so the second never passes; the state of earlier pages is let go.
@query("stream_dedup_watermark", f"with {DISCOVERED_SQL} select distinct url_norm from hosts")
def stream_dedup_watermark(spark, folder):
    landing, out = work_path(spark, "timed-items"), work_path(spark, "timed-deduped")
    at = (F.lit(0) + F.col("page") * 3600).cast("timestamp")
    items = materialize(discovered(spark, folder).select("url", "page", at.alias("at"), F.col("page").alias("seq")), "timed")
    _land_in_order(items, landing)
    deduped = dedup_stream(file_stream(spark, landing, items.schema, files_per_batch=1), ("at", "3 hours"))
    run = (
        deduped.writeStream.format("parquet").option("checkpointLocation", work_path(spark, "timed-checkpoint"))
        .option("path", out).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("url_norm")


@query(
    "dedup_against_corpus",
    f"""with {DISCOVERED_SQL}, known as (select distinct url_norm from hosts where page_url in (select url from seen)),
    visited as (select *, row_number() over (partition by url_norm order by page, bucket_pos, pos) as place from hosts)
    select url_norm, url, bucket, page, pos from visited where place = 1 and url_norm not in (select url_norm from known)""",
)
def dedup_table(spark, folder):
    persisted = table(spark, folder, "pages").where(F.contains("url", F.lit("utm_source=feed")))
    fresh = dedup_against_corpus(discovered(spark, folder), persisted, visit_order())
    return fresh.select("url_norm", "url", "bucket", "page", "pos")


# Admitted pages through text extraction and the article contract to the corpus.
_INGEST_SQL = f"""{ADMITTED_SQL},
fetched as (
  select a.page, a.bucket_pos, a.pos, a.url, a.bucket, {sql_page_text('p.html')} as content
  from admitted a join pages p on p.url = a.page_url
),
valid as (
  select *, sha1(content) as content_id, row_number() over (order by page, bucket_pos, pos) as seq from fetched
  where length(content) >= 10
)"""


@query(
    "ingest_pages",
    f"""with {_INGEST_SQL}
    select url, content_id, content, bucket from valid
    where seq in (select min(seq) from valid group by content_id)""",
)
def ingest_pages(spark, folder):
    admitted = admit_static(discovered(spark, folder), seen(spark, folder), QUOTA, buckets=len(BUCKETS))
    items = align_schema(
        admitted.withColumn("seq", F.col("page") * (1 << 40) + F.col("bucket_pos") * (1 << 36) + F.col("pos")),
        ITEMS,
    )
    batch = materialize(to_corpus_batch(to_articles(items, table(spark, folder, "pages"))), "batch")
    nothing = spark.createDataFrame([], CORPUS)
    after = upsert_corpus(nothing, batch, F.lit(STAMP).cast("timestamp"))
    return after.select("url", "content_id", "content", "bucket")


# The same chain over a stream, without quotas: first offers of new URLs, rejects beside the corpus.
@query(
    "ingest_page_stream",
    f"""with {DISCOVERED_SQL},
    known as (select distinct url_norm from hosts where page_url in (select url from seen)),
    visited as (
      select *, row_number() over (partition by url_norm order by page, bucket_pos, pos) as place from hosts
      where url_norm not in (select url_norm from known)
    ),
    fetched as (
      select v.page, v.bucket_pos, v.pos, v.url, v.bucket, {sql_page_text('p.html')} as content
      from visited v join pages p on p.url = v.page_url where place = 1
    ),
    valid as (
      select *, sha1(content) as content_id, row_number() over (order by page, bucket_pos, pos) as seq from fetched
      where length(content) >= 10
    )
    select url, content_id, bucket, true as kept from valid where seq in (select min(seq) from valid group by content_id)
    union all
    select url, sha1(content), bucket, false from fetched where length(content) < 10""",
)
def ingest_page_stream(spark, folder):
    landing, rejected = work_path(spark, "found-items"), work_path(spark, "rejects")
    order = F.col("page") * (1 << 40) + F.col("bucket_pos") * (1 << 36) + F.col("pos")
    found = materialize(discovered(spark, folder).withColumn("seq", order.cast("bigint")), "found")
    _land_in_order(found, landing)
    pages, persisted = table(spark, folder, "pages"), seen(spark, folder)
    store = CorpusTable(spark, work_path(spark, "page-table"), buckets=8)

    def shaped(batch):
        """First offers of URLs that are not persisted, stored or rejected yet, with their page's text."""
        known = known_urls(persisted, store.read(), _stored_rejects(spark, rejected))
        fresh = align_schema(dedup_against_corpus(batch, known, visit_order()), ITEMS)
        return shaped_articles(with_page_text(fresh, pages))

    run = ingest_stream(
        file_stream(spark, landing, found.schema, files_per_batch=1), store, "pages", work_path(spark, "page-checkpoint"),
        lambda rows: to_corpus_batch(valid_articles(rows)), prepare=shaped,
        rejects=lambda rows: rejected_articles(rows).select(*REJECTED), rejects_path=rejected,
    )
    run.awaitTermination()
    kept = store.read().select("url", "content_id", "bucket", F.lit(True).alias("kept"))
    return kept.unionByName(_stored_rejects(spark, rejected).withColumn("kept", F.lit(False)))


REJECTED = ("url", "content_id", "bucket")
LANDED_ROWS = 100_000


def _land_in_order(found, landing: str) -> None:
    """Files of consecutive rows, one after the other: the stream takes them in the order of their times."""
    files = max(3, -(-found.count() // LANDED_ROWS))
    cuts = found.approxQuantile("seq", [i / files for i in range(1, files)], 0.01)
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        part = found if low is None else found.where(F.col("seq") > low)
        part = part if high is None else part.where(F.col("seq") <= high)
        part.coalesce(1).write.mode("append").parquet(landing)


def _stored_rejects(spark, path: str):
    schema = ", ".join(f"{c} string" for c in REJECTED)
    try:
        return spark.read.schema(schema).parquet(f"{path}/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
