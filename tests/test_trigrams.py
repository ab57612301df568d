"""Keyword search over the trigram index against the scan."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators.filters import keyword_match
from newsloom.operators.search import keyword_search
from newsloom.operators.trigrams import TrigramIndex, _posted, needed, trigrams
from newsloom.schemas import CORPUS
from newsloom.sources.union import align_schema

QUERIES = ("abc", "ABCA", "cab ab", "a%bcab", "ab_cab", "ab", "%", "é€a", "zzzz", "50% off", "c\\da", "_abc", "title 7")


def corpus_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice("abc dé€") for _ in range(rng.randint(0, 60)))
        date = None if i % 7 == 0 else f"2026-01-{1 + i % 28:02d} 10:00:00"
        rows.append((f"u{i:04d}", f"c{i}", None if i % 11 == 0 else f"Title {i}", None if i % 13 == 0 else text, date, "en" if i % 2 else "fr"))
    return rows + [("x1", "x1", "50% OFF", "C\\Dab", "2026-01-05 00:00:00", "en"), ("x2", "x2", "", "", None, "en")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(corpus_rows(400), "url string, content_id string, title string, content string, date string, bucket string")
    return align_schema(rows, CORPUS).cache()


@pytest.fixture(scope="module")
def index(corpus):
    return TrigramIndex.build(corpus, rows_per_block=37)


@pytest.mark.parametrize("q", QUERIES)
def test_same_rows_as_the_scan(corpus, index, q):
    for filters in ({}, {"bucket": "en"}, {"date_from": "2026-01-10", "date_to": "2026-01-12"}):
        scan = keyword_search(corpus, q, 20, **filters).collect()
        assert index.search(q, 20, **filters).collect() == scan
    every = sorted(r["url"] for r in keyword_match(corpus, q).collect())
    found = index.match(q)
    assert sorted(r["url"] for r in found.collect()) == every and found.columns == corpus.columns


def test_blocks_follow_the_dates_and_hold_all_rows(corpus, index):
    rows = index.rows.orderBy("block", "row").select("url").collect()
    assert rows == corpus.orderBy(F.col("date").desc_nulls_last(), "url").select("url").collect()
    assert index.rows.select("block").distinct().count() > 5


def test_lists_name_the_rows_of_each_trigram(index):
    text = F.concat_ws("\x00", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit(""))))
    want = {}
    for r in index.rows.select("block", "row", text.alias("t")).collect():
        for part in r["t"].split("\x00"):
            for i in range(len(part) - 2):
                want.setdefault((r["block"], part[i : i + 3]), set()).add(r["row"])
    got = {(r["block"], r["gram"]): r["rows"] for r in index.lists.collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_only_blocks_with_all_trigrams_are_opened(spark):
    rows = [(f"u{i:04d}", f"c{i}", "t", "needle in hay" if i == 123 else "hay stack", f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(500)]
    df = align_schema(spark.createDataFrame(rows, "url string, content_id string, title string, content string, date string"), CORPUS)
    index = TrigramIndex.build(df, rows_per_block=25)
    assert [r["url"] for r in index.search("needle", 5).collect()] == ["u0123"]
    plan = index.match("needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(block#\d+\), \(block#\d+ = \d+\)", plan)
    assert index.rows.select("block").distinct().count() == 20


def test_needed():
    assert needed("ab") == [] and needed("%ab_cd%") == [] and needed("AbCd") == ["abc", "bcd"]


def test_trigrams_of_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("ab",), ("aBcABc",), ("😀é€",), ("x" * 200_000,)], "t string")
    got = [sorted(r[0]) for r in df.select(trigrams(F.col("t"))).collect()]
    assert got == [[], [], [], ["abc", "bca", "cab"], ["😀é€"], ["xxx"]]


def test_empty_corpus(spark):
    empty = align_schema(spark.createDataFrame([], "url string, content_id string"), CORPUS)
    index = TrigramIndex.build(empty)
    assert index.search("abc").count() == 0 and index.match("ab").count() == 0


def test_lists_of_a_block_in_parts(corpus, index, monkeypatch):
    """Several parts a block, and letters of the whole of Unicode, give the same rows."""
    monkeypatch.setattr("newsloom.operators.trigrams.PART_ROWS", 5)
    wide = "".join(chr(0x10000 + i) for i in range(90_000)) + "\x00\x00a\x00"
    grams, starts, rows = _posted([7, 9], [["abca", "bc"], [wide, ""]])
    want = {"abc": {7}, "bca": {7}} | {wide[i : i + 3]: {9} for i in range(len(wide) - 2)}
    assert {g: set(part) for g, part in zip(grams, np.split(rows, starts[1:]), strict=True)} == want
    spark = corpus.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        parts = TrigramIndex.build(corpus, rows_per_block=37)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts.lists.groupBy("block").agg(F.count_distinct("part").alias("n")).where("n > 1").count() > 5
    for q in ("abc", "a%bcab", "é€a"):
        assert sorted(r["url"] for r in parts.match(q).collect()) == sorted(r["url"] for r in keyword_match(corpus, q).collect())


def test_trigrams_are_listed_without_a_row_each(spark, tmp_path):
    """No move of texts and no row a trigram on the way: lists leave the task that reads the texts."""
    n = 300
    text = "".join(chr(0x4E00 + i) for i in range(3_000))
    df = align_schema(spark.range(n).selectExpr("cast(id as string) url", f"'{text}' content", "'c' content_id"), CORPUS)
    index = TrigramIndex.build(df, rows_per_block=100)
    assert index.lists.where("size(rows) = 1").isEmpty() and index.lists.columns == ["block", "part", "gram", "rows", "shard"]
    assert len({r["shard"] for r in index.lists.where(F.col("gram") == text[:3]).select("shard").collect()}) == 1
    plan = index.candidates([text[:3]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
