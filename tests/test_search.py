"""Filters, paging, ranking and similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import filters, ranking, search, similarity
from newsloom.operators.aggregates import corpus_stats, rolling_dup_rate
from newsloom.operators.encoder import encode_hashed, encode_query
from newsloom.operators.joins import pending_embeddings
from newsloom.operators.similarity import cosine_topk, cosine_topk_batch, with_similarity
from newsloom.plans.embed import embed_incremental
from newsloom.schemas import CORPUS, VECTORS
from newsloom.sources.union import align_schema

ARTICLES = [
    ("u1", "Leaders drop points again", "premier_league", "trends", "Daily Post", "2026-03-01 10:00:00"),
    ("u2", "Keeper signs for Torino", "serie_a", "transfers", "ABC Press", "2026-03-03 10:00:00"),
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(u, u, t, lg, s, p, d) for u, t, lg, s, p, d in ARTICLES]
    df = spark.createDataFrame(
        rows, "url string, content_id string, title string, league string, signal_type string, publisher_name string, date string"
    )
    return align_schema(df, CORPUS)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def urls(df):
    return [r["url"] for r in df.collect()]


def test_filter_articles(small):
    assert urls(filters.filter_articles(small, league="serie_a", signal_type="transfers", date_column="date")) == ["u2"]
    window = filters.filter_articles(small, date_from="2026-03-02", date_to="2026-03-04", date_column="date")
    assert urls(window) == ["u2"]


def test_filters_ignore_blank_and_unreadable(small):
    assert len(urls(filters.where_corpus(small, bucket="", publisher_name=None, date_from="soon", date_to=""))) == 2
    assert urls(filters.where_corpus(small, date_to="2026-03-01")) == ["u1"]
    assert urls(filters.where_corpus(small, publisher_name="abc p")) == ["u2"]
    assert urls(filters.where_corpus(small, publisher_name="a_c")) == ["u2"]


def test_keyword_wildcards_and_backslash(spark):
    df = align_schema(spark.createDataFrame([("a", "50% off"), ("b", "c\\d")], "url string, title string"), CORPUS)
    assert sorted(urls(search.keyword_search(df, "5%f"))) == ["a"]
    assert urls(search.keyword_search(df, "C\\D")) == ["b"]
    with pytest.raises(ValueError):
        search.keyword_search(df, "")
    with pytest.raises(ValueError):
        search.browse_articles(df, limit=101)


def test_deep_paging_matches_plain_order(spark, monkeypatch):
    monkeypatch.setattr(search, "SHALLOW_OFFSET", 10)
    rng = random.Random(5)
    rows = []
    for i in range(600):
        day, hour = (1, rng.randrange(3)) if rng.random() < 0.5 else (rng.randrange(2, 9), rng.randrange(24))
        at = f"2024-01-{day:02d} {hour:02d}:{rng.randrange(3):02d}:{rng.randrange(60):02d}"
        rows.append((f"u{i:03d}", None if rng.random() < 0.1 else at))
    df = align_schema(spark.createDataFrame(rows, "url string, date string"), CORPUS)
    known = sorted([r for r in rows if r[1]], key=lambda r: r[0])
    known.sort(key=lambda r: r[1], reverse=True)
    order = [r[0] for r in known] + sorted(r[0] for r in rows if not r[1])
    for offset in (0, 9, 57, 300, 530, 545, 590, 700):
        assert urls(search.browse_articles(df, limit=40, offset=offset)) == order[offset : offset + 40]


def test_browse_after_continues(small):
    assert urls(search.browse_after(small, 10, "2026-03-03 10:00:00", "u2")) == ["u1"]
    assert urls(search.browse_after(small, 10, None, "u0")) == []


def vector_table(spark, matrix, prefix="v"):
    rows = [(f"{prefix}{i:04d}", f"url{i}", None, [float(x) for x in row], None) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, VECTORS)


def brute(matrix, query, k, prefix="v"):
    m = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    q = np.asarray(query, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        sims = (m @ q) / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
    order = sorted((-round(s, 10), f"{prefix}{i:04d}") for i, s in enumerate(sims) if not np.isnan(s))
    return [name for _, name in order[:k]]


def test_topk_with_copies_and_zero_vectors(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(400, 12))
    matrix[100:260] = matrix[7]
    matrix[5] = 0.0
    query = (matrix[7] + 0.01).tolist()
    table = vector_table(spark, matrix).repartition(6)
    got = [r["content_id"] for r in cosine_topk(table, query, 50).collect()]
    assert got == brute(matrix, query, 50)
    scored = with_similarity(table, query)
    assert scored.count() == 400 and filters.min_similarity(scored, 0.0).where("content_id = 'v0005'").isEmpty()


def test_topk_skips_other_lengths(spark):
    table = vector_table(spark, [[1.0, 0.0], [0.0, 1.0]]).unionByName(vector_table(spark, [[1.0]], "w"))
    assert [r["content_id"] for r in cosine_topk(table, [1.0, 0.1], 5).collect()] == ["v0000", "v0001"]


def test_batch_forms_agree(spark):
    rng = np.random.default_rng(3)
    matrix, wanted = rng.normal(size=(300, 8)), rng.normal(size=(25, 8))
    table = vector_table(spark, matrix)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in q]) for i, q in enumerate(wanted)], "query_id string, embedding array<double>")
    shipped = cosine_topk_batch(table, queries, 7, dim=8)
    blocked = cosine_topk_batch(table, queries, 7, dim=8, max_cells=16, block_rows=40, block_queries=10)
    pick = lambda df: {(r["query_id"], r["rank"]): r["content_id"] for r in df.collect()}
    want = {(f"q{i}", n + 1): c for i, q in enumerate(wanted) for n, c in enumerate(brute(matrix, q, 7))}
    assert pick(shipped) == want and pick(blocked) == want


def test_semantic_search_modes(spark):
    table = vector_table(spark, [[1, 0], [0.9, 0.1], [0.8, 0.3], [0, 1]])
    meta = spark.createDataFrame(
        [("v0001", "m1", "serie_a", None, "trends"), ("v0002", "m2", None, "serie_a", "trends"), ("v0003", "m3", "serie_a", None, "trends")],
        "content_id string, url string, league string, bucket string, signal_type string",
    )
    corpus = align_schema(meta, CORPUS)
    every = search.semantic_search(table, corpus, [1.0, 0.0], limit=4)
    assert [(r["content_id"], r["similarity"]) for r in every.collect()][0] == ("v0000", 1.0)
    assert every.count() == 4
    post = search.semantic_search(table, corpus, [1.0, 0.0], limit=1, topic="serie_a", overfetch=1)
    assert post.count() == 0
    pre = search.semantic_search(table, corpus, [1.0, 0.0], limit=1, topic="serie_a", overfetch=1, mode="prefilter")
    assert [r["content_id"] for r in pre.collect()] == ["v0001"]
    floor = search.semantic_search(table, corpus, [1.0, 0.0], limit=4, floor=0.95)
    assert [r["content_id"] for r in floor.collect()] == ["v0000", "v0001"]
    blank = search.semantic_search(table, corpus, None)
    assert blank.count() == 0 and blank.columns == every.columns


def test_cell_index_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 3
    matrix = np.concatenate([c + rng.normal(size=(80, 16)) for c in centres])
    table = vector_table(spark, matrix)
    index = search.CellIndex.build(table, lists=40)
    assert len(index.centres) == 40
    hits = []
    for row in (3, 500, 1200):
        exact = set(brute(matrix, matrix[row], 20))
        near = {r["content_id"] for r in index.search(matrix[row].tolist(), 20).collect()}
        hits.append(len(exact & near) / 20)
    assert np.mean(hits) >= 0.9
    whole = index.search(matrix[3].tolist(), 20, probes=40)
    assert [r["content_id"] for r in whole.collect()] == brute(matrix, matrix[3], 20)
    few = {f for r in index.probed(matrix[3].tolist(), 8).select(F.input_file_name().alias("f")).distinct().collect() for f in r}
    every = {f for r in index.table.select(F.input_file_name().alias("f")).distinct().collect() for f in r}
    assert 0 < len(few) < len(every) / 2
    assert "PartitionFilters: [" in plan_of(index.probed(matrix[3].tolist(), 8)) and index.search([0.0] * 16, 5).count() == 0


def test_cell_index_is_kept(spark, tmp_path):
    matrix = np.random.default_rng(1).normal(size=(60, 8))
    built = search.CellIndex.build(vector_table(spark, matrix), 4, str(tmp_path / "index"))
    again = search.CellIndex.open(spark, str(tmp_path / "index"))
    assert np.array_equal(built.centres, again.centres)
    assert [r["content_id"] for r in again.search(matrix[0].tolist(), 5, probes=4).collect()] == brute(matrix, matrix[0], 5)


def test_width_comes_from_the_queries(spark):
    matrix = np.random.default_rng(2).normal(size=(30, 64))
    table = vector_table(spark, matrix)
    asked = spark.createDataFrame([("q", matrix[4].tolist())], "query_id string, embedding array<double>")
    assert [r["content_id"] for r in similarity.cosine_topk_batch(table, asked, 3).orderBy("rank").collect()] == brute(matrix, matrix[4], 3)
    mixed = asked.unionByName(spark.createDataFrame([("r", [1.0])], asked.schema))
    with pytest.raises(ValueError):
        similarity.cosine_topk_batch(table, mixed, 3)
    odd = table.withColumn("embedding", F.when(F.col("content_id") == "v0001", F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    assert [tuple(r) for r in similarity.misfits(odd, 64).collect()] == [(3, 1)]


def test_texts_move_once_and_vectors_not_at_all(spark, tmp_path):
    """What is pending is settled on ids."""
    for name, schema in (("corpus", CORPUS), ("vectors", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    corpus_, vectors_ = (spark.read.parquet(str(tmp_path / n)) for n in ("corpus", "vectors"))
    reads = [line for line in plan_of(pending_embeddings(corpus_, vectors_)).splitlines() if line.startswith("ReadSchema")]
    assert not any("embedding" in line for line in reads) and sum("content:" in line for line in reads) == 1


def test_deep_pages_push_their_dates_down(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SHALLOW_OFFSET", 100)
    rows = spark.range(3000).selectExpr(
        "concat('u', id) as url", "timestamp_micros(id * 60000000L) as date", "'t' as title", "'c' as content"
    )
    align_schema(rows, CORPUS).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    narrowed, left = search._narrow_to_page(stored, 2500, 10)
    assert "GreaterThanOrEqual(date" in plan_of(narrowed) and "LessThan(date" in plan_of(narrowed)
    page = narrowed.orderBy(*search.newest_first()).offset(left).limit(10).collect()
    assert [r["url"] for r in page] == [f"u{2999 - 2500 - i}" for i in range(10)]


def test_encoder(spark):
    df = spark.createDataFrame([("a", "The cat, the hat"), ("b", ""), ("c", "x1 y2")], "k string, t string")
    rows = {r["k"]: np.array(r["embedding"]) for r in encode_hashed(df, "k", F.col("t"), 32).collect()}
    assert np.isclose(np.linalg.norm(rows["a"]), 1) and not rows["b"].any() and len(rows["c"]) == 32
    assert np.isclose(rows["a"].max(), 2 / np.sqrt(6)) or (rows["a"] > 0).sum() < 3
    assert np.allclose(rows["a"], encode_query(spark, "hat THE cat the", 32))


def test_embedding_is_incremental(spark, small):
    at = F.lit("2026-01-01").cast("timestamp")
    none = spark.createDataFrame([], VECTORS)
    first = embed_incremental(small, none, dim=16, at=at)
    assert first.count() == 2
    again = embed_incremental(small, first, dim=16, at=F.lit("2027-01-01").cast("timestamp"))
    assert again.where(F.col("embedded_at") > F.lit("2026-06-01")).count() == 0 and again.count() == 2


@pytest.mark.parametrize("k", [3, 1500])
def test_first_k_both_ways(spark, k):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 9000).alias("o"))
    kept = ranking.first_k(df, ["g"], [F.col("o")], F.lit(k), k, F.floor(F.col("o") / 100))
    want = {g: sorted(r["o"] for r in df.where(F.col("g") == g).collect())[:k] for g in range(3)}
    got = {g: [] for g in range(3)}
    for r in kept.collect():
        got[r["g"]].append(r["o"])
    assert {g: sorted(v) for g, v in got.items()} == want


@pytest.mark.parametrize("before, block", [(True, 7), (False, 7), (True, None), (False, None)])
def test_nearest_in_key(spark, before, block):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    out = ranking.nearest_in_key(df, "k", "o", F.col("v"), before=before, block=block and F.floor(F.col("o") / block), name="near")
    for r in out.collect():
        others = [v for k, o, v in rows if k == r["k"] and v is not None and (o < r["o"] if before else o > r["o"])]
        assert r["near"] == ((max(others) if before else min(others)) if others else None)


def test_rolling_dup_rate(spark):
    rates = [0.9, 0.5, 0.6, 0.7, 0.8, 0.2]
    df = spark.createDataFrame([("a", i * 2, r) for i, r in enumerate(rates)], "bucket string, page bigint, dup_rate double")
    rows = rolling_dup_rate(df, block_pages=3).orderBy("page").collect()
    for i, r in enumerate(rows):
        last = rates[max(0, i - 3) : i + 1]
        assert r["mean_dup_rate"] == sum(last) / len(last) and r["window_size"] == len(last)
    assert [r["flagged"] for r in rows] == [False, False, False, True, True, False]


def test_stats_of_empty_corpus(spark):
    rows = {(r["section"], r["key"]): r["value"] for r in corpus_stats(spark.createDataFrame([], CORPUS)).collect()}
    assert rows[("total", "articles")] == 0 and rows[("date_range", "latest_micros")] is None
