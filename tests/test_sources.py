"""Feed documents and API pages to item rows."""

import re

import json

from pyspark.sql import functions as F

from newsloom.config import TOPICS
from newsloom.operators.joins import attribute_topic
from newsloom.schemas import DISCOVERED
from newsloom.sources.api import api_items, api_page_meta, malformed_api_items
from newsloom.sources.feeds import feed_items
from newsloom.sources.files import read_jsonl, write_jsonl
from newsloom.sources.tables import publish_snapshot, read_snapshot
from newsloom.sources.topics import bucket_dim, feed_dim
from newsloom.sources.union import align_schema, union_sources

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:atom="http://www.w3.org/2005/Atom"><channel>
<title>Sport Wire</title>
<item><title> Lazio &amp; Roma draw </title><link>https://example.com/a</link>
<description>Lazio and Roma share the points.</description><pubDate>Tue, 11 Feb 2025 19:30:00 GMT</pubDate>
<category>Transfers</category><category> </category><category term="cup">x</category>
<media:thumbnail url="t.png"/><enclosure type="image/png" url="e.png"/></item>
<item><title>no link</title></item>
<item><link> </link><atom:link href="https://example.com/b"/><summary>fallback</summary><pubDate>whenever</pubDate>
<enclosure type="image/jpeg" url="e.jpg"/></item>
<item><link>https://example.com/c</link><media:thumbnail width="3"/><enclosure type="image/png" url="e.png"/></item>
<item><link>https://example.com/d</link><enclosure type="audio/mpeg" url="e.mp3"/></item>
</channel></rss>"""

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom Feed</title>
<entry><title>first</title><link rel="alternate" href="https://example.com/1"/><link href="other"/>
<content>body</content><updated>2025-01-01T00:00:00Z</updated><category term="k"/></entry>
<entry><title>second</title><link rel="self"/></entry></feed>"""


def feeds(spark, *rows):
    return spark.createDataFrame(rows, "feed_url string, feed_name string, league string, body string")


def test_rss_items(spark):
    items = feed_items(feeds(spark, ("https://wire.example.org/it.xml", "Sport Wire", "serie_a", RSS))).collect()
    assert [i["url"] for i in items] == [f"https://example.com/{c}" for c in "abcd"]
    first = items[0]
    assert (first["league"], first["source_type"], first["source_feed"], first["publisher_name"]) == (
        "serie_a", "rss", "https://wire.example.org/it.xml", "Sport Wire",
    )
    assert first["title"] == "Lazio & Roma draw" and "Lazio" in first["excerpt"]
    assert first["keywords"] == ["Transfers", "cup"]
    assert [i["thumbnail"] for i in items] == ["t.png", "e.jpg", None, None]
    assert items[1]["excerpt"] == "fallback"
    assert [i["date_status"] for i in items] == ["ok", "bad", "missing", "missing"]


def test_namespaces_whatever_their_prefix(spark):
    rss = RSS.replace("xmlns:media", "xmlns:m.x").replace("<media:", "<m.x:").replace("xmlns:atom", "xmlns:a10")
    rss = rss.replace("<atom:", "<a10:").replace("</atom:", "</a10:")
    atom = '<?xml version="1.0"?><!-- feed -->' + re.sub(r"<(/?)([a-z])", r"<\1at:\2", ATOM.replace("xmlns=", "xmlns:at="))
    plain, other = (
        feed_items(feeds(spark, ("f1", None, "x", a), ("f2", None, "x", b))).orderBy("source_feed", "pos").collect()
        for a, b in ((RSS, ATOM), (rss, atom))
    )
    assert plain == other and len(plain) > 2


def test_atom_malformed_and_names(spark):
    items = feed_items(feeds(spark, ("f1", None, "x", ATOM), ("f2", "n", "x", "<rss><chan"), ("f3", "n", "x", None))).collect()
    assert [(i["url"], i["publisher_name"], i["excerpt"], i["keywords"]) for i in items] == [
        ("https://example.com/1", "Atom Feed", "body", ["k"])
    ]


def test_item_limit_counts_mapped_items(spark):
    body = "<rss><channel>" + "".join(
        f"<item>{'' if i % 3 == 0 else f'<link>https://e.com/{i}</link>'}</item>" for i in range(120)
    ) + "</channel></rss>"
    urls = [r["url"] for r in feed_items(feeds(spark, ("f", "n", "x", body))).collect()]
    assert urls == [f"https://e.com/{i}" for i in range(120) if i % 3][:50]


ITEMS = [
    {"url": "https://e.com/1", "title": None, "publisher": {"name": "P"}, "authors": "A", "keywords": ["k", None, 2],
     "contentLength": "12", "date": "2025-01-01T00:00:00Z", "paywall": True},
    {"url": "https://e.com/2", "contentLength": 0, "content_length": 7},
    {"url": None, "title": "x"},
    {"url": "https://e.com/3", "publisher": None},
    "not an object",
    {"url": "https://e.com/4", "title": "T", "excerpt": "E", "contentLength": "n/a", "content_length": 9, "date": "soon"},
    {"url": "https://e.com/5", "contentLength": 3.7, "publisher": {}},
]


def test_api_items(spark):
    pages = spark.createDataFrame([(1, json.dumps({"data": ITEMS})), (2, "{oops"), (3, "{}")], "page int, body string")
    rows = {r["url"][-1]: r for r in api_items(pages).collect()}
    assert sorted(rows) == ["1", "2", "4", "5"]
    assert (rows["1"]["title"], rows["2"]["title"]) == (None, "No title")
    assert (rows["1"]["excerpt"], rows["4"]["excerpt"]) == ("", "E")
    assert rows["1"]["authors"] == ["A"] and rows["1"]["keywords"] == ["k", "2"] and rows["1"]["paywall"] is True
    assert [rows[k]["content_length"] for k in "1245"] == [12, 7, None, 3]
    assert rows["1"]["publisher_name"] == "P" and rows["5"]["publisher_name"] is None
    assert rows["4"]["date_status"] == "bad"
    assert [r["pos"] for r in malformed_api_items(pages).orderBy("pos").collect()] == [2, 3, 4]


def test_api_meta(spark):
    bodies = [{"totalHits": 101, "size": 50}, {"totalHits": 10, "totalPages": 9}, {}, {"totalHits": 60}]
    pages = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "page int, body string")
    rows = api_page_meta(pages).orderBy("page").collect()
    assert [(r["total_hits"], r["total_pages"], r["page_size"]) for r in rows] == [
        (101, 3, 50), (10, 9, 50), (0, 0, 50), (60, 2, 50),
    ]


def test_topics(spark):
    assert bucket_dim(spark).count() == 5
    assert feed_dim(spark).count() == sum(len(t[4]) for t in TOPICS) == 14
    rows = spark.createDataFrame([("finance", None), ("serie_a", "x")], "bucket string, league string")
    got = {(r["bucket"], r["league"]) for r in attribute_topic(rows).collect()}
    assert got == {("finance", None), ("football", "serie_a")}


def test_union_and_align(spark):
    a = spark.createDataFrame([("u",)], "url string")
    b = spark.createDataFrame([("v", "t")], "url string, title string")
    both = union_sources(a, b).orderBy("source_ordinal").collect()
    assert [(r["url"], r["title"], r["source_ordinal"]) for r in both] == [("u", None, 0), ("v", "t", 1)]
    assert align_schema(a, DISCOVERED).schema == DISCOVERED


def test_snapshots_and_jsonl(spark, tmp_path):
    root = str(tmp_path / "snap")
    one = spark.createDataFrame([(1, None)], "a int, b string")
    publish_snapshot(one, root)
    publish_snapshot(one.withColumn("a", F.lit(2)), root)
    assert [r["a"] for r in read_snapshot(spark, root).collect()] == [2]
    lines = str(tmp_path / "lines")
    write_jsonl(one, lines)
    write_jsonl(spark.createDataFrame([(3, "é")], "a int, b string"), lines)
    text = sorted(r["value"] for r in spark.read.text(lines).collect())
    assert text == ['{"a":1,"b":null}', '{"a":3,"b":"é"}']
    assert read_jsonl(spark, lines, one.schema).count() == 2
