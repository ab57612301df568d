"""Wide columns move at most once."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html
from newsloom.operators.joins import attach_page_text
from newsloom.operators.search import browse_articles
from newsloom.schemas import CORPUS
from newsloom.sources.union import align_schema


@pytest.fixture
def plain_plans(spark):
    """Shuffled joins, and the whole plan at once."""
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exchanges_with(df, column):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return sum(1 for inputs in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text) if re.search(rf"\b{column}#", inputs))


def test_pages_move_once(spark, plain_plans):
    items = spark.createDataFrame([("u1", "x", False), ("u2", "y", True)], "url_norm string, excerpt string, paywall boolean")
    pages = spark.createDataFrame([(1, "u1", "<p>text</p>"), (2, "u2", "<p>more</p>")], "page_id long, url string, html string")
    joined = attach_page_text(items, pages, html.page_text(F.col("html")))
    assert exchanges_with(joined, "html") == 1


def test_a_page_of_articles_is_picked_without_contents(spark, tmp_path):
    rows = [(f"u{i:03d}", "t", "c" * 50, f"2026-01-{1 + i % 28:02d}") for i in range(200)]
    df = align_schema(spark.createDataFrame(rows, "url string, title string, content string, date string"), CORPUS)
    df.write.parquet(str(tmp_path / "corpus"))
    page = browse_articles(spark.read.parquet(str(tmp_path / "corpus")), limit=3)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(url, [" in plan or "In(url" in plan
    assert [r["url"] for r in page.collect()] == ["u027", "u055", "u083"]
