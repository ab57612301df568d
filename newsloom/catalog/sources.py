"""Feed documents and API pages written from the documents table, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import query
from newsloom.catalog.fixtures import ARTICLES_SQL, articles, sql_time, time_text
from newsloom.sources.api import api_items, api_page_meta, malformed_api_items
from newsloom.sources.feeds import feed_items
from newsloom.sources.union import union_sources

FEED_DOCS = 60
API_DOCS = 25
# Characters XML 1.0 cannot carry.
NOT_XML = r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _escape(column):
    text = F.replace(F.regexp_replace(column, NOT_XML, ""), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, column, attributes: str = ""):
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), column, F.lit(f"</{name}>")), F.lit(""))


def _ordered_join(column, order: str = "seq"):
    """Texts of one bounded chunk of rows, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column.alias("x")))), lambda r: r["x"]), "")


def feed_bodies(spark, folder):
    """One feed document per 60 documents: RSS and Atom in turn."""
    rows = articles(spark, folder).withColumn("chunk", F.floor(F.col("seq") / FEED_DOCS))
    rss = F.col("chunk") % 2 == 0
    has_link = F.col("seq") % 7 != 3
    title = _element("title", F.when(F.col("seq") % 5 != 2, _escape(F.col("title"))))
    body = _escape(F.col("content"))
    rss_item = F.concat(
        F.lit("<item>"), title,
        F.when(has_link, _element("link", _escape(F.col("url")))).otherwise(F.lit("<link> </link>")),
        F.when(F.col("seq") % 2 == 0, _element("description", body)).otherwise(_element("summary", body)),
        _element("pubDate", F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")),
        _element("category", F.col("bucket")), F.lit("<category> </category>"),
        F.concat(F.lit('<category term="'), "publisher_name", F.lit('">ignored</category>')),
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit('<media:thumbnail url="'), "url", F.lit('.png"/>'))).otherwise(F.lit("")),
        F.when(F.col("seq") % 4 == 0, F.lit('<enclosure type="image/png" url="pic.png"/>')).otherwise(F.lit('<enclosure type="audio/mp3" url="a.mp3"/>')),
        F.lit("</item>"),
    )
    atom_entry = F.concat(
        F.lit("<entry>"), title,
        F.when(has_link, F.concat(F.lit('<link rel="alternate" href="'), "url", F.lit('"/><link href="other"/>'))).otherwise(F.lit("")),
        F.when(F.col("seq") % 2 == 0, _element("summary", body)).otherwise(_element("content", body, ' type="text"')),
        F.when(F.col("seq") % 3 == 0, _element("published", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise(
            _element("updated", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        ),
        F.concat(F.lit('<category term="'), "bucket", F.lit('"/>')),
        F.lit("</entry>"),
    )
    feeds = rows.select("seq", "chunk", F.when(rss, rss_item).otherwise(atom_entry).alias("item"))
    docs = feeds.groupBy("chunk").agg(_ordered_join(F.col("item")).alias("items"))
    head = F.lit('<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Feed title</title>')
    xml = F.when(
        F.col("chunk") % 2 == 0, F.concat(head, "items", F.lit("</channel></rss>"))
    ).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom title</title>'), "items", F.lit("</feed>")))
    # every other RSS document declares prefixes of its own, every other Atom one prefixes all of its elements
    own = F.replace(F.replace(xml, F.lit("<media:"), F.lit("<m.x:")), F.lit("xmlns:media"), F.lit("xmlns:m.x"))
    own = F.replace(own, F.lit("<rss "), F.lit('<rss xmlns:a10="http://www.w3.org/2005/Atom" '))
    own = F.regexp_replace(own, r"<link>(http[^<]*)</link>", '<a10:link href="$1"/>')
    prefixed = F.regexp_replace(F.replace(xml, F.lit("xmlns="), F.lit("xmlns:at=")), r"<(/?)([a-z])", "<$1at:$2")
    xml = F.when(F.col("chunk") % 4 == 2, own).when(F.col("chunk") % 4 == 3, prefixed).otherwise(xml)
    return docs.select(
        F.concat(F.lit("https://feeds.example.com/"), F.col("chunk").cast("string")).alias("feed_url"),
        F.when(F.col("chunk") % 3 == 0, F.concat(F.lit("Feed "), F.col("chunk").cast("string"))).alias("feed_name"),
        F.lit("serie_a").alias("league"),
        xml.alias("body"),
    )


def _xml_text(column: str) -> str:
    return f"trim(regexp_replace({column}, '{NOT_XML}', '', 'g'))"


FEED_ITEMS_SQL = f"""{ARTICLES_SQL},
linked as (
  select *, seq // {FEED_DOCS} as chunk, row_number() over (partition by seq // {FEED_DOCS} order by seq) - 1 as pos
  from articles where seq % 7 <> 3
),
feed_items as (
  select *, 'https://feeds.example.com/' || chunk as source_feed_url, chunk % 2 = 0 as rss from linked where pos < 50
)"""


@query(
    "feed_items",
    f"""with {FEED_ITEMS_SQL}
    select source_feed_url as source_feed, pos, url, 'rss' as source_type, 'serie_a' as league,
           case when chunk % 3 = 0 then 'Feed ' || chunk when rss then 'Feed title' else 'Atom title' end as publisher_name
    from feed_items""",
)
def items_of_feeds(spark, folder):
    return feed_items(feed_bodies(spark, folder)).select(
        "source_feed", F.col("pos").cast("bigint").alias("pos"), "url", "source_type", "league", "publisher_name"
    )


@query(
    "feed_field_fallbacks",
    f"""with {FEED_ITEMS_SQL}
    select source_feed_url as source_feed, pos, case when seq % 5 <> 2 then {_xml_text('title')} end as title,
           {_xml_text('content')} as excerpt,
           {sql_time("date_trunc('second', date)")} as published_date,
           case when date is null then 'missing' else 'ok' end as date_status
    from feed_items""",
)
def feed_field_fallbacks(spark, folder):
    rows = feed_items(feed_bodies(spark, folder))
    return rows.select(
        "source_feed", F.col("pos").cast("bigint").alias("pos"), "title", "excerpt",
        time_text("published_date").alias("published_date"), "date_status",
    )


@query(
    "feed_keywords",
    f"""with {FEED_ITEMS_SQL}
    select source_feed_url as source_feed, pos, case when rss then bucket || '|' || publisher_name else bucket end as keywords from feed_items""",
)
def feed_keywords(spark, folder):
    rows = feed_items(feed_bodies(spark, folder))
    return rows.select("source_feed", F.col("pos").cast("bigint").alias("pos"), F.array_join("keywords", "|").alias("keywords"))


@query(
    "feed_thumbnail",
    f"""with {FEED_ITEMS_SQL}
    select source_feed_url as source_feed, pos,
           case when not rss then null when seq % 3 = 0 then url || '.png' when seq % 4 = 0 then 'pic.png' end as thumbnail
    from feed_items""",
)
def feed_thumbnail(spark, folder):
    rows = feed_items(feed_bodies(spark, folder))
    return rows.select("source_feed", F.col("pos").cast("bigint").alias("pos"), "thumbnail")


@query(
    "feed_item_limit",
    f"with {FEED_ITEMS_SQL} select source_feed_url as source_feed, count(*) as n from feed_items group by 1",
)
def feed_item_limit(spark, folder):
    return feed_items(feed_bodies(spark, folder)).groupBy("source_feed").agg(F.count("*").alias("n"))


def api_bodies(spark, folder):
    """One JSON result page per 25 documents, with absent, null and malformed members."""
    rows = articles(spark, folder).withColumn("page", F.floor(F.col("seq") / API_DOCS))
    seq = F.col("seq")
    good = F.to_json(
        F.struct(
            "url",
            F.when(seq % 5 != 1, F.col("title")).alias("title"),
            F.when(seq % 6 != 2, F.col("content")).alias("excerpt"),
            F.when(seq % 4 == 0, True).alias("paywall"),
            F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
            F.when(seq % 9 != 4, F.struct(F.col("publisher_name").alias("name"))).alias("publisher"),
            F.when(seq % 3 == 0, F.array("bucket", "source_type")).alias("keywords"),
            F.when(seq % 8 == 0, F.col("bucket")).alias("authors"),
            F.when(seq % 2 == 0, seq.cast("string")).when(seq % 10 == 1, F.lit("n/a")).alias("contentLength"),
            F.when(seq % 2 == 1, seq + 1).alias("content_length"),
        )
    )
    item = F.when(seq % 11 == 4, F.concat(F.lit('{"url":"'), "url", F.lit('","publisher":null}'))).otherwise(
        F.when(seq % 13 == 6, F.lit('{"url":null,"title":"no address"}')).otherwise(good)
    )
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("x")))), lambda r: r["x"]), ","
    )
    pages = rows.groupBy("page").agg(listed.alias("items"), F.count("*").alias("n"))
    meta = F.when(F.col("page") % 2 == 0, F.concat(F.lit('"totalHits":'), F.col("n") * 7, F.lit(',"size":25,'))).otherwise(
        F.lit('"totalPages":3,"totalHits":60,')
    )
    return pages.select("page", F.concat(F.lit("{"), meta, F.lit('"data":['), "items", F.lit("]}")).alias("body"))


_API_SQL = f"""{ARTICLES_SQL},
listed as (
  select *, seq // {API_DOCS} as page, row_number() over (partition by seq // {API_DOCS} order by seq) - 1 as pos,
         seq % 11 = 4 or seq % 13 = 6 as malformed
  from articles
)"""


@query(
    "api_items",
    f"""with {_API_SQL}
    select page, pos, url, case when seq % 5 <> 1 then title else 'No title' end as title,
           case when seq % 6 <> 2 then content else '' end as excerpt, seq % 4 = 0 as paywall,
           case when seq % 9 <> 4 then publisher_name end as publisher_name,
           {sql_time("date_trunc('second', date)")} as published_date,
           case when seq % 8 = 0 then bucket else '' end as authors,
           case when seq % 3 = 0 then concat_ws('|', bucket, source_type) else '' end as keywords,
           cast(case when seq % 2 = 0 then seq when seq % 10 = 1 then null else seq + 1 end as int) as content_length
    from listed where not malformed""",
)
def items_of_api(spark, folder):
    rows = api_items(api_bodies(spark, folder))
    return rows.select(
        "page", F.col("pos").cast("bigint").alias("pos"), "url", "title", "excerpt", "paywall", "publisher_name",
        time_text("published_date").alias("published_date"), F.array_join("authors", "|").alias("authors"),
        F.array_join("keywords", "|").alias("keywords"), "content_length",
    )


@query("malformed_api_items", f"with {_API_SQL} select page, pos from listed where malformed")
def malformed(spark, folder):
    return malformed_api_items(api_bodies(spark, folder)).select("page", F.col("pos").cast("bigint").alias("pos"))


@query(
    "api_page_meta",
    f"""with {_API_SQL}, counts as (select page, count(*) as n from listed group by 1)
    select page, case when page % 2 = 0 then n * 7 else 60 end as total_hits,
           case when page % 2 = 0 then cast(ceil(n * 7 / 25) as bigint) else 3 end as total_pages,
           case when page % 2 = 0 then 25 else 50 end as page_size from counts""",
)
def page_meta(spark, folder):
    return api_page_meta(api_bodies(spark, folder))


@query(
    "union_sources",
    f"""with {FEED_ITEMS_SQL}, listed as (select seq, url, seq % 11 = 4 or seq % 13 = 6 as malformed from articles)
    select 0 as source_ordinal, 'rss' as source_type, url, source_feed_url as source_feed from feed_items
    union all select 1, 'api', url, null from listed where not malformed""",
)
def union_of_sources(spark, folder):
    both = union_sources(feed_items(feed_bodies(spark, folder)), api_items(api_bodies(spark, folder)))
    return both.select("source_ordinal", "source_type", "url", "source_feed")
