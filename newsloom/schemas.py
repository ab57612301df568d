"""Explicit schemas of the tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name type, name type"; unlike DDL parsing it needs no session."""
    named = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


DISCOVERED = _struct(
    "url string, title string, excerpt string, paywall boolean, authors array<string>, "
    "keywords array<string>, publisher_name string, published_date timestamp, thumbnail string, "
    "content_length int, league string, signal_type string, source_type string, source_feed string"
)

ARTICLES = _struct(
    "url string, content_id string, title string, excerpt string, paywall boolean, "
    "authors array<string>, keywords array<string>, thumbnail string, content_length int, "
    "extracted_content_length int, content string, published_date timestamp, publisher_name string, "
    "publisher_domain string, bucket string, league string, signal_type string, source_type string, "
    "source_feed string, crawl_ts timestamp"
)

CORPUS = _struct(
    "url string, publisher_name string, date timestamp, content_id string, title string, "
    "content string, bucket string, league string, signal_type string, source_type string, "
    "source_feed string, url_norm string, inserted_at timestamp"
)

VECTORS = _struct(
    "content_id string, url string, title string, embedding array<float>, embedded_at timestamp"
)

# Element lists seen in feed entries. Names carry their prefix; attributes take "_".
_CATEGORY = "array<struct<_term:string,_VALUE:string>>"
_ATOM_LINK = "array<struct<_href:string>>"
RSS_ITEM = (
    "struct<title:string,link:string,description:string,summary:string,pubDate:string,published:string,"
    f"category:{_CATEGORY},enclosure:array<struct<_type:string,_url:string>>,"
    "`media:thumbnail`:array<struct<_url:string,_VALUE:string,_width:string>>,"
    f"`atom:link`:{_ATOM_LINK},`atom:title`:string,`atom:summary`:string,`atom:content`:string,"
    f"`atom:published`:string,`atom:updated`:string,`atom:category`:{_CATEGORY}>"
)
ATOM_ENTRY = (
    f"struct<title:string,link:{_ATOM_LINK},summary:string,content:string,published:string,updated:string,"
    f"category:{_CATEGORY},`media:thumbnail`:array<struct<_url:string,_VALUE:string,_width:string>>>"
)
FEED_BODY = (
    f"channel struct<title:string,item:array<{RSS_ITEM}>>, title string, entry array<{ATOM_ENTRY}>"
)
