"""Browse, keyword and semantic queries over the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import SEARCH_OVERFETCH
from newsloom.functions.text import snippet
from newsloom.operators.filters import keyword_match, min_similarity, post_filter_hits, where_corpus
from newsloom.operators.joins import META_COLUMNS, hydrate_hits
from newsloom.operators.similarity import TIE_DIGITS, cosine_topk, with_similarity
from newsloom.session import work_path

ARTICLE_COLUMNS = (
    "url", "title", "content", "publisher_name", "published_date", "content_id", "bucket",
    "signal_type", "source_type", "source_feed",
)
RESULT_COLUMNS = (
    "url", "title", "content", "publisher_name", "published_date", "content_id", "similarity",
    "bucket", "signal_type", "source_type",
)


def check_range(name: str, value: float, low: float, high: float | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must lie between {low} and {high}: {value}")


def newest_first() -> list[Column]:
    return [F.col("date").desc_nulls_last(), F.col("url").asc()]


def article_projection(df: DataFrame, truncate: bool = False) -> DataFrame:
    content = snippet(F.col("content")) if truncate else F.col("content")
    return df.select(
        *[
            content.alias(c) if c == "content" else F.col("date").alias(c) if c == "published_date" else F.col(c)
            for c in ARTICLE_COLUMNS
        ]
    )


SHALLOW_OFFSET = 10_000
_UNITS = ("day", "hour", "minute", "second")


def _narrow_to_page(rows: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """The rows around a deep page, and the offset left inside them.

    Counts per day, then per hour, minute and second of the day the page falls into,
    tell how many rows lie in front; only the units the page touches are sorted.
    """
    for unit in _UNITS:
        if offset <= SHALLOW_OFFSET:
            break
        bucket = F.unix_micros(F.date_trunc(unit, "date"))
        counts = rows.groupBy(bucket.alias("at")).agg(F.count("*").alias("n")).orderBy(F.col("at").desc_nulls_last())
        before, first, last, seen = 0, None, None, 0
        for row in counts.toLocalIterator():
            if first is None and seen + row["n"] > offset:
                first, before = row, seen
            seen += row["n"]
            last = row
            if first is not None and seen >= offset + limit:
                break
        if first is None:
            return rows.where(F.lit(False)), 0
        inside = F.lit(False)
        if first["at"] is not None:
            # Bounds on the date itself reach the files' statistics.
            inside = F.col("date") < F.expr(f"timestamp_micros({first['at']}) + interval 1 {unit}")
            if last["at"] is not None:
                inside = inside & (F.col("date") >= F.expr(f"timestamp_micros({last['at']})"))
        if last["at"] is None:
            inside = inside | F.col("date").isNull()
        rows, offset = rows.where(inside), offset - before
    return rows, offset


def _fetched(corpus: DataFrame, page: DataFrame, truncate: bool = False) -> DataFrame:
    """The articles of a page of (date, url), at most 100 rows.

    The page is picked on these two columns; contents are read for its dates and URLs only,
    which reach the files' statistics.
    """
    names = page.select(F.unix_micros("date").alias("at"), "url").collect()
    times = [r["at"] for r in names if r["at"] is not None]
    near = F.col("date").isNull() if len(times) < len(names) else F.lit(False)
    if times:
        ends = (F.expr(f"timestamp_micros({t})") for t in (min(times), max(times)))
        near = near | F.col("date").between(*ends)
    rows = corpus.where(F.col("url").isin([r["url"] for r in names]) & near)
    return article_projection(rows.orderBy(*newest_first()), truncate)


def browse_articles(corpus: DataFrame, limit: int = 10, offset: int = 0, **filters) -> DataFrame:
    """One page of the filtered corpus, newest first."""
    check_range("limit", limit, 1, 100)
    check_range("offset", offset, 0, None)
    rows, left = _narrow_to_page(where_corpus(corpus, **filters), offset, limit)
    return _fetched(corpus, rows.select("date", "url").orderBy(*newest_first()).offset(left).limit(limit))


def browse_after(corpus: DataFrame, limit: int, after_date, after_url: str, **filters) -> DataFrame:
    """The page behind a given (date, url): costs the same however deep it lies."""
    check_range("limit", limit, 1, 100)
    rows = where_corpus(corpus, **filters)
    if after_date is None:
        behind = F.col("date").isNull() & (F.col("url") > after_url)
    else:
        at = F.lit(after_date).cast("timestamp")
        behind = (F.col("date") < at) | ((F.col("date") == at) & (F.col("url") > after_url)) | F.col("date").isNull()
    return _fetched(corpus, rows.where(behind).select("date", "url").orderBy(*newest_first()).limit(limit))


def keyword_search(corpus: DataFrame, q: str, limit: int = 10, **filters) -> DataFrame:
    """Articles with the text in title or content, newest first, contents cut to snippets."""
    if not q:
        raise ValueError("q must not be empty")
    check_range("limit", limit, 1, 50)
    hits = keyword_match(where_corpus(corpus, **filters), q).select("date", "url")
    return _fetched(corpus, hits.orderBy(*newest_first()).limit(limit), truncate=True)


def _bounded(df: DataFrame) -> DataFrame:
    """A top-k result as a local table, so that using it twice does not scan twice."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def semantic_search(
    vectors: DataFrame, corpus: DataFrame, query: list[float] | None, limit: int = 10, floor: float = 0.0,
    topic: str | None = None, signal_type: str | None = None, mode: str = "postfilter",
    overfetch: int = SEARCH_OVERFETCH,
) -> DataFrame:
    """Ranked articles near a query vector.

    ``postfilter`` takes the nearest ``overfetch * limit`` vectors and filters those, so it
    may give fewer than ``limit`` rows; ``prefilter`` searches only vectors whose article
    passes. A null query (blank text) gives no rows.
    """
    check_range("limit", limit, 1, 50)
    check_range("floor", floor, 0.0, 1.0)
    pool = overfetch * limit
    if query is None:
        query, vectors = [1.0], vectors.where(F.lit(False))
    if mode == "prefilter" and (topic or signal_type):
        # Scored first, so that numbers rather than vectors meet the filter.
        allowed = post_filter_hits(corpus, topic, signal_type).select("content_id")
        scored = with_similarity(vectors, query).where(~F.isnan("similarity")).join(allowed, "content_id", "left_semi")
        nearest = scored.orderBy(F.round("similarity", TIE_DIGITS).desc(), "content_id").limit(pool)
    else:
        nearest = cosine_topk(vectors, query, pool)
    hits = min_similarity(_bounded(nearest), floor)
    hydrated = post_filter_hits(hydrate_hits(hits, corpus, pool), topic, signal_type)
    best = hydrated.orderBy(F.round("similarity", TIE_DIGITS).desc(), "content_id").limit(limit)
    return best.withColumn("similarity", F.round("similarity", 4)).select(
        "content_id", "similarity", *META_COLUMNS
    )


def result_projection(results: DataFrame) -> DataFrame:
    """The response shape of semantic results."""
    shaped = results.select(
        *[c for c in results.columns if c not in ("content", "date", "bucket")],
        snippet(F.col("content")).alias("content"),
        F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("published_date"),
        F.coalesce(F.nullif("bucket", F.lit("")), "league").alias("bucket"),
    )
    return shaped.select(*RESULT_COLUMNS)


class CellIndex:
    """Vectors filed under their nearest k-means centre.

    Centres are fitted on all vectors that have a direction. The table is partitioned by cell,
    so a search reads only the files of the cells nearest to the query; it ranks those vectors
    exactly. An index is kept under a path and can be opened again.
    """

    def __init__(self, table: DataFrame, centres: np.ndarray):
        self.table = table
        self.centres = centres

    @classmethod
    def build(cls, vectors: DataFrame, lists: int, path: str | None = None, seed: int = 7) -> CellIndex:
        """File ``vectors`` under ``lists`` centres; about the square root of their number is usual."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import Normalizer
        from pyspark.ml.functions import array_to_vector

        path = path or work_path(vectors.sparkSession, "cells")
        usable = vectors.where(F.exists("embedding", lambda x: x != 0))
        as_vector = usable.withColumn("_raw", array_to_vector(F.col("embedding").cast("array<double>")))
        unit = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(as_vector)
        model = KMeans(k=lists, seed=seed, featuresCol="_unit", predictionCol="cell", maxIter=20).fit(unit.select("_unit"))
        filed = model.transform(unit).drop("_raw", "_unit")
        # AQE splits a large cell over several tasks, so none has to write it alone.
        filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        spark = vectors.sparkSession
        spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        """An index built earlier. The centres are as many as its lists."""
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return cls(spark.read.parquet(f"{path}/cells"), np.array([r["centre"] for r in rows]))

    def probed(self, query: list[float], probes: int) -> DataFrame:
        """The vectors of the ``probes`` cells nearest to a query that has a direction."""
        q = np.asarray(query, dtype=np.float64)
        near = np.argsort(((self.centres - q / np.linalg.norm(q)) ** 2).sum(axis=1), kind="stable")[:probes]
        return self.table.where(F.col("cell").isin([int(c) for c in near]))

    def search(self, query: list[float], k: int, probes: int = 8) -> DataFrame:
        """The k nearest of the probed cells; none for a zero query, which has no direction."""
        candidates = self.probed(query, probes) if np.any(query) else self.table.where(F.lit(False))
        return cosine_topk(candidates, query, k)
