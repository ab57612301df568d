"""Joins between corpus, vectors, pages and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.fixtures import (
    CORPUS_SQL,
    DISCOVERED_SQL,
    VECTORS_SQL,
    articles,
    corpus,
    corpus_facts,
    discovered,
    sql_time,
    table,
    time_text,
    vectors,
)
from newsloom.config import TOPICS
from newsloom.functions import html, urls
from newsloom.functions.text import WHITESPACE
from newsloom.operators import joins as ops


@query(
    "pending_embeddings",
    f"with {VECTORS_SQL} select content_id, url, title from corpus where content_id not in (select content_id from vectors)",
)
def pending_embeddings(spark, folder):
    return ops.pending_embeddings(corpus(spark, folder), vectors(spark, folder)).select("content_id", "url", "title")


@query(
    "unembedded_ids",
    f"with {VECTORS_SQL} select content_id from articles except select content_id from vectors",
)
def unembedded_ids(spark, folder):
    return ops.unembedded_ids(articles(spark, folder), vectors(spark, folder))


@query(
    "already_embedded",
    f"with {VECTORS_SQL} select content_id from articles intersect select content_id from vectors",
)
def already_embedded(spark, folder):
    return ops.already_embedded(articles(spark, folder), vectors(spark, folder))


@query(
    "hydrate_hits",
    f"""with {VECTORS_SQL}
    select v.content_id, coalesce(nullif(v.url, ''), c.url, '') as url, coalesce(nullif(v.title, ''), c.title) as title,
           c.bucket, c.signal_type, {sql_time('c.date')} as date
    from vectors v left join corpus c on v.content_id = c.content_id""",
)
def hydrate_hits(spark, folder):
    hits = vectors(spark, folder).select("content_id", "url", "title")
    # Every vector is a hit here: no row bound, so no broadcast hint.
    hydrated = ops.hydrate_hits(hits, corpus_facts(spark, folder), rows=1 << 40)
    return hydrated.select("content_id", "url", "title", "bucket", "signal_type", time_text("date").alias("date"))


DROPPED_SQL = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in html.DROPPED_ELEMENTS)


def sql_page_text(column: str) -> str:
    text = column
    for pattern in (f"(?is){DROPPED_SQL}", html.COMMENT_PATTERN, html.HEAD_PATTERN, html.TAG_PATTERN):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    for entity, char in html.ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim(regexp_replace({text}, '{WHITESPACE}', ' ', 'g'))"


@query("page_text", f"select page_id, {sql_page_text('html')} as content from pages")
def page_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", html.page_text(F.col("html")).alias("content"))


@query(
    "attach_page_text",
    f"""with {DISCOVERED_SQL},
    texts as (select url, {sql_page_text('html')} as page_text from pages),
    items as (select d.*, 'excerpt of ' || pos as excerpt, pos % 4 = 1 as paywall, t.page_text
              from discovered d join texts t on t.url = d.page_url)
    select bucket, page, pos, case when paywall then excerpt else coalesce(nullif(page_text, ''), excerpt) end as content from items""",
)
def attach_page_text(spark, folder):
    items = _fetched_items(spark, folder)
    pages = table(spark, folder, "pages")
    return ops.attach_page_text(items, pages, html.page_text(F.col("html"))).select("bucket", "page", "pos", "content")


def _fetched_items(spark, folder):
    return discovered(spark, folder).select(
        "bucket", "page", "pos", urls.normalize_url(F.col("url")).alias("url_norm"),
        F.concat(F.lit("excerpt of "), F.col("pos").cast("string")).alias("excerpt"),
        (F.col("pos") % 4 == 1).alias("paywall"),
    )


def _sql_marked(column: str) -> str:
    text = f"coalesce({column}, '')"
    for pattern, mark in html.MARKINGS:
        mark = " || ".join(f"chr({ord(c)})" for c in mark)
        text = f"regexp_replace({text}, '{pattern}', {mark}, 'g')"
    for entity, char in html.ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def _sql_plain(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '{html.MARKS_PATTERN}', ' ', 'g'), '{WHITESPACE}', ' ', 'g'))"


def _sql_words(text: str) -> str:
    return f"case when {text} = '' then 0 else length({text}) - length(replace({text}, ' ', '')) + 1 end"


MAIN_SQL = f"""marked as (select page_id, url, {_sql_marked('html')} as m from pages),
inside as (select *, regexp_extract(m, '{html.CONTAINER_PATTERN}', 1) as part from marked),
pieces as (
  select page_id, url, unnest(p) as piece, generate_subscripts(p, 1) as nth from (
    select page_id, url, string_split(case when length(part) >= {html.CONTAINER_CHARS} then part else m end, chr(3)) as p from inside)
),
plain as (
  select *, {_sql_plain('piece')} as text,
         {_sql_plain(f"array_to_string(regexp_extract_all(piece, '{html.LINKED_PATTERN}'), ' ')")} as linked from pieces
),
counted as (
  select page_id, url, row_number() over (partition by page_id order by nth) as block, text,
         {_sql_words('text')} as words, {_sql_words('linked')} as links from plain where text <> ''
),
around as (
  select *, coalesce(lead(words - links) over w, 0) as next_words, coalesce(lag(words - links) over w, 0) as last_words,
         coalesce(9 * lag(links) over w > 5 * lag(words) over w, false) as after_menu
  from counted window w as (partition by page_id order by block)
),
judged as (
  select *, 3 * links <= words and case when after_menu then words > 40 or next_words > 17
    else words > 16 or next_words > 15 or last_words > 4 end as main from around
),
main_texts as (
  select p.page_id, p.url, coalesce(string_agg(j.text, ' ' order by j.block) filter (j.main), '') as main_text
  from pages p left join judged j on p.page_id = j.page_id group by p.page_id, p.url
)"""


@query("main_text", f"with {MAIN_SQL} select page_id, main_text as content from main_texts")
def main_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", html.main_text(F.col("html")).alias("content"))


@query(
    "text_blocks",
    f"""with {MAIN_SQL} select page_id, cast(block as integer) as block, sha1(text) as text_sha1,
    cast(words as integer) as words, cast(links as integer) as links, main from judged""",
)
def text_blocks(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.posexplode(html.main_blocks(F.col("html"))).alias("at", "b"))
    return pages.select(
        "page_id", (F.col("at") + 1).alias("block"), F.sha1("b.text").alias("text_sha1"), "b.words", "b.links", "b.main"
    )


@query(
    "attach_main_text",
    f"""with {DISCOVERED_SQL}, {MAIN_SQL},
    items as (select d.*, 'excerpt of ' || pos as excerpt, pos % 4 = 1 as paywall, t.main_text
              from discovered d join main_texts t on t.url = d.page_url)
    select bucket, page, pos, case when paywall then excerpt else coalesce(nullif(main_text, ''), excerpt) end as content from items""",
)
def attach_main_text(spark, folder):
    items = _fetched_items(spark, folder)
    pages = table(spark, folder, "pages")
    return ops.attach_page_text(items, pages, html.main_text(F.col("html"))).select("bucket", "page", "pos", "content")


_KEYS = [t[0] for t in TOPICS]
_DIM_SQL = ", ".join(f"('{k}', '{d}', '{label}', {i})" for i, (k, d, label, _, _) in enumerate(TOPICS))


@query(
    "attach_config",
    f"""with dim(bucket, domain, label, bucket_pos) as (values {_DIM_SQL})
    select doc_id, d.bucket, d.domain, d.label, d.bucket_pos from documents
    join dim d on d.bucket_pos = doc_id % 5""",
)
def attach_config(spark, folder):
    keys = F.array(*[F.lit(k) for k in _KEYS])
    items = table(spark, folder, "documents").select(
        "doc_id", F.get(keys, (F.col("doc_id") % 5).cast("int")).alias("bucket")
    )
    return ops.attach_config(items).select("doc_id", "bucket", "domain", "label", "bucket_pos")


_FEEDS = [(t[0], i, name, url) for t in TOPICS for i, (name, url) in enumerate(t[4])]
_FEED_SQL = ", ".join(f"({n}, '{b}', {i}, '{name}', '{url}')" for n, (b, i, name, url) in enumerate(_FEEDS))


@query(
    "attach_feed",
    f"""with dim(n, bucket, feed_pos, feed_name, feed_url) as (values {_FEED_SQL})
    select doc_id, d.bucket, d.feed_pos, d.feed_name, d.feed_url from documents join dim d on d.n = doc_id % {len(_FEEDS)}""",
)
def attach_feed(spark, folder):
    links = F.array(*[F.lit(f[3]) for f in _FEEDS])
    items = table(spark, folder, "documents").select(
        "doc_id", F.get(links, (F.col("doc_id") % len(_FEEDS)).cast("int")).alias("feed_url")
    )
    return ops.attach_feed(items).select("doc_id", "bucket", "feed_pos", "feed_name", "feed_url")


@query("read_corpus", f"with {CORPUS_SQL} select url, content_id, title, {sql_time('date')} as date from corpus")
def read_corpus(spark, folder):
    from newsloom.catalog.tables import stored_corpus
    from newsloom.sources.files import read_corpus as scan

    return scan(spark, stored_corpus(spark, folder)).select("url", "content_id", "title", time_text("date").alias("date"))
