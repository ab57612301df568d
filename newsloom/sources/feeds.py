"""RSS and Atom feed documents to item rows.

Input: one row per fetched feed with ``feed_url``, ``feed_name``, ``league`` and the
document ``body``. Everything happens inside the row until one final explode, so the
per-feed item limit needs neither a shuffle nor a window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import ITEMS_PER_PAGE
from newsloom.functions.binding import let
from newsloom.functions.dates import date_status, parse_feed_date
from newsloom.functions.text import non_blank
from newsloom.schemas import FEED_BODY

# Namespaces of feed elements (fixed values).
ATOM_URI = "http://www.w3.org/2005/Atom"
MEDIA_URI = "http://search.yahoo.com/mrss/"


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[non_blank(v) for v in values])


def _first_href(links: Column) -> Column:
    return F.get(links, 0)["_href"]


def _category_terms(*lists: Column) -> Column:
    """Terms of every category in order: the attribute first, else the text; blanks go."""
    empty = F.array().cast("array<struct<_term:string,_VALUE:string>>")
    merged = F.concat(*[F.coalesce(values, empty) for values in lists])
    terms = F.transform(
        merged, lambda c: F.coalesce(F.nullif(c["_term"], F.lit("")), non_blank(c["_VALUE"]))
    )
    return F.filter(terms, lambda t: t.isNotNull())


def _thumbnail(media: Column, enclosures: Column | None) -> Column:
    """A media thumbnail decides alone, even without an address; else an image enclosure."""
    first = F.get(media, 0)
    if enclosures is None:
        return first["_url"]
    enclosure = F.get(enclosures, 0)
    return F.when(F.size(F.coalesce(media, F.array().cast("array<struct<_url:string,_VALUE:string,_width:string>>"))) > 0,
                  first["_url"]).when(enclosure["_type"].startswith("image/"), enclosure["_url"])


def _item_struct(link, title, excerpt, published, keywords, thumbnail) -> Column:
    return F.struct(
        link.alias("url"), title.alias("title"), excerpt.alias("excerpt"),
        published.alias("published_text"), keywords.alias("keywords"), thumbnail.alias("thumbnail"),
    )


def _from_rss(item: Column) -> Column:
    return _item_struct(
        F.coalesce(non_blank(item["link"]), _first_href(item["atom:link"])),
        _first_filled(item["title"], item["atom:title"]),
        _first_filled(item["description"], item["summary"], item["atom:summary"], item["atom:content"]),
        _first_filled(item["pubDate"], item["published"], item["atom:published"], item["atom:updated"]),
        _category_terms(item["category"], item["atom:category"]),
        _thumbnail(item["media:thumbnail"], item["enclosure"]),
    )


def _from_atom(entry: Column) -> Column:
    return _item_struct(
        _first_href(entry["link"]),
        non_blank(entry["title"]),
        _first_filled(entry["summary"], entry["content"]),
        _first_filled(entry["published"], entry["updated"]),
        _category_terms(entry["category"]),
        _thumbnail(entry["media:thumbnail"], None),
    )


def _same_prefixes(body: Column) -> Column:
    """The document with the prefixes that the schema names, whatever it declares for them.

    Prefixes bound to the Atom and media namespaces become ``atom:`` and ``media:``; in a
    document whose root is an Atom feed, Atom's prefix goes, as if it were the default.
    """

    def declared(text: Column, uri: str) -> Column:
        pattern = rf"xmlns:([A-Za-z_][\w.-]*)\s*=\s*[\"']{re.escape(uri)}[\"']"
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def renamed(text: Column, uri: str, to: Column) -> Column:
        tag = lambda prefix: F.concat(F.lit(r"<(/?)\Q"), prefix, F.lit(r"\E:"))
        return F.aggregate(
            declared(text, uri), text, lambda doc, prefix: F.regexp_replace(doc, tag(prefix), F.concat(F.lit("<$1"), to))
        )

    atom_root = F.rlike(body, F.lit(r"^(?:\s|<[?][^>]*>|<!--.*?-->|<![A-Z][^>]*>)*<(?:[A-Za-z_][\w.-]*:)?feed[\s>]"))
    to = F.when(atom_root, F.lit("")).otherwise(F.lit("atom:"))
    return let(renamed(body, ATOM_URI, to), lambda doc: renamed(doc, MEDIA_URI, F.lit("media:")))


ITEM_TYPE = (
    "struct<url:string,title:string,excerpt:string,published_text:string,"
    "keywords:array<string>,thumbnail:string>"
)


def feed_items(feeds: DataFrame, limit: int = ITEMS_PER_PAGE) -> DataFrame:
    """Items of every feed in document order, RSS items before Atom entries.

    Items without a link do not count towards ``limit``. A body that cannot be parsed
    gives no rows. Columns of ``feeds`` other than ``body`` are carried along.
    """
    carried = [c for c in feeds.columns if c != "body"]
    none = F.array().cast(f"array<{ITEM_TYPE}>")
    doc = F.col("_doc")
    rss = F.coalesce(F.transform(doc["channel"]["item"], _from_rss), none)
    atom = F.coalesce(F.transform(doc["entry"], _from_atom), none)
    mapped = F.filter(F.concat(rss, atom), lambda i: F.coalesce(i["url"], F.lit("")) != "")
    parsed = feeds.withColumn("_doc", F.from_xml(_same_prefixes(F.col("body")), FEED_BODY))
    resolved = F.coalesce(
        F.nullif(F.col("feed_name"), F.lit("")),
        non_blank(doc["channel"]["title"]),
        non_blank(doc["title"]),
        F.lit("RSS Feed"),
    )
    items = parsed.select(
        *carried, resolved.alias("publisher_name"), F.posexplode(F.slice(mapped, 1, limit)).alias("pos", "item")
    )
    published = parse_feed_date(F.col("item.published_text"))
    return items.select(
        *[c for c in carried if c not in ("feed_name", "league")],
        "pos",
        F.col("item.url").alias("url"),
        F.col("item.title").alias("title"),
        F.col("item.excerpt").alias("excerpt"),
        F.lit(False).alias("paywall"),
        F.array().cast("array<string>").alias("authors"),
        F.col("item.keywords").alias("keywords"),
        "publisher_name",
        published.alias("published_date"),
        date_status(F.col("item.published_text"), published).alias("date_status"),
        F.col("item.thumbnail").alias("thumbnail"),
        F.lit(None).cast("int").alias("content_length"),
        "league",
        F.lit(None).cast("string").alias("signal_type"),
        F.lit("rss").alias("source_type"),
        F.col("feed_url").alias("source_feed"),
    )
