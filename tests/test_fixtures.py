"""The derived tables: what they read and move."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom.catalog import fixtures, load
from newsloom.functions import topics

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("title, content, bucket, word", [
    ("a", "the release", "clause", "x"), ("a", "the release", None, "clause"), ("a", "the", "release", "Clause"),
    ("a", "b title", None, "race"), ("a", "b title", "", "race"), ("a", "b", "c", None), ("a", "b", None, None),
    ("a", "b trend", "c", "loans"), ("A LOAN", "b", "c", "trend"), ("a", "b", "signi", "ng"), ("a", "b", "c", "table"),
])
def test_signal_from_its_parts(spark, title, content, bucket, word):
    row = spark.createDataFrame([(title, content, bucket, word)], "t string, c string, b string, w string")
    parts = topics.signal_parts(F.col("t"), F.col("c"), F.col("b"))
    whole = topics.classify_signal(F.col("t"), F.col("c"), F.array("b", "w"))
    got = row.select(parts.alias("p"), "w", whole.alias("whole")).select(topics.signal_with(F.col("p"), F.col("w")).alias("s"), "whole").first()
    assert got["s"] == got["whole"]


def test_texts_are_judged_before_their_events_are_joined(spark):
    docs = spark.createDataFrame([(1, "some ten letters", "en", "s"), (1, "another text", "en", "s"), (None, "no id at all", "en", "s"), (2, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    events = spark.createDataFrame([(10, "2026-01-01", "a"), (10, "2026-01-02", "b"), (None, None, "c"), (11, None, "d")], "event_id long, ts string, event_type string")
    rows = fixtures.shape_articles(docs, events)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Generate")
    found = sorted((r["seq"] or 0, r["content"], r["source_type"] or "") for r in rows.collect())
    assert found == [(0, "no id at all", ""), (1, "another text", "a"), (1, "another text", "b"), (1, "some ten letters", "a"), (1, "some ten letters", "b")]


@pytest.mark.parametrize("name", ["league_label", "hydrate_hits", "corpus_stats", "embedding_stats"])
def test_contents_are_not_read_where_none_is_asked_for(spark, name):
    frame = load()[name][0](spark, SMALL)
    assert not any(re.search("/(corpus|articles)-[0-9a-f]{32}", f) for f in frame.inputFiles())
    assert "content:" not in frame._jdf.queryExecution().executedPlan().toString()
