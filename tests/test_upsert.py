"""The two-key upsert against a row-by-row replay."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from newsloom.operators import kept_stats
from newsloom.operators.aggregates import corpus_stats
from newsloom.operators.upsert import corpus_changes, upsert_corpus, upsert_vectors, winning_rows
from newsloom.schemas import CORPUS
from newsloom.sources.tables import CorpusTable
from newsloom.sources.union import align_schema

OLD, NEW = "2026-01-01 00:00:00", "2026-02-01 00:00:00"


def replay(state, batch):
    """Plain replay: state maps url -> (content, title, inserted)."""
    state = dict(state)
    for _, url, content, title in sorted(batch):
        owner = next((u for u, row in state.items() if content is not None and row[0] == content), None)
        if owner is not None and owner != url:
            continue
        state[url] = (content, title, state[url][2] if url in state else NEW)
    return state


def tables(spark, state, batch):
    existing = spark.createDataFrame(
        [(u, c, t, i) for u, (c, t, i) in state.items()], "url string, content_id string, title string, inserted_at string"
    ).withColumn("inserted_at", F.col("inserted_at").cast("timestamp"))
    rows = spark.createDataFrame(batch, "seq bigint, url string, content_id string, title string")
    return align_schema(existing, CORPUS), _with_payload(rows)


def _with_payload(rows):
    for field in CORPUS.fields:
        if field.name not in rows.columns and field.name != "inserted_at":
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows


def result(df):
    rows = df.select("url", "content_id", "title", F.col("inserted_at").cast("string")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


@pytest.mark.parametrize("seed", [1, 3, 4])
def test_random_batches_match_replay(spark, seed):
    rng = random.Random(seed)
    urls = [f"u{i}" for i in range(rng.choice([4, 8, 12]))]
    contents = [f"c{i}" for i in range(rng.choice([3, 6, 12]))] + ([None] if seed % 2 else [])
    state = {}
    for u in urls:
        free = [c for c in contents if c is not None and all(row[0] != c for row in state.values())]
        if free and rng.random() < 0.5:
            state[u] = (rng.choice(free), "old", OLD)
    batch = [(i * 3, rng.choice(urls), rng.choice(contents), f"t{i}") for i in range(rng.choice([10, 30, 60]))]
    existing, rows = tables(spark, state, batch)
    after = upsert_corpus(existing, rows, F.lit(NEW).cast("timestamp"), block=rng.choice([4, 16, 1000]))
    assert result(after) == replay(state, batch)


def test_one_content_offered_by_most_rows(spark):
    batch = [(i, f"u{i % 400}", "hot" if i % 3 == 0 else f"c{i}", f"t{i}") for i in range(1200)]
    existing, rows = tables(spark, {"u0": ("hot", "old", OLD)}, batch)
    after = upsert_corpus(existing, rows, F.lit(NEW).cast("timestamp"), block=64)
    assert result(after) == replay({"u0": ("hot", "old", OLD)}, batch)


def test_repeated_batch_changes_nothing_new(spark):
    batch = [(0, "a", "x", "1"), (1, "b", "x", "2"), (2, "a", "y", "3"), (3, "c", "x", "4")]
    existing, rows = tables(spark, {}, batch)
    winners = {(r["url"], r["seq"]) for r in winning_rows(existing, rows).collect()}
    assert winners == {("a", 2), ("c", 3)}


def test_table_versions(spark, tmp_path):
    store = CorpusTable(spark, str(tmp_path / "t"), buckets=4)
    state = {}
    rng = random.Random(3)
    for round_ in range(4):
        batch = [(i, f"u{rng.randrange(12)}", f"c{rng.randrange(14)}", f"r{round_}-{i}") for i in range(12)]
        _, rows = tables(spark, {}, batch)
        store.upsert(rows, tag=f"b{round_}", batch_ts=F.lit(NEW).cast("timestamp"))
        assert store.upsert(rows, tag=f"b{round_}") == 0
        state = replay(state, batch)
        assert result(store.read()) == state
    stray = store.read().limit(1).withColumn("ub", F.lit(0))
    stray.write.partitionBy("ub").parquet(str(tmp_path / "t" / "rows" / "commit=9"))
    assert result(store.read()) == state


def test_vectors_keep_identity(spark):
    schema = "seq int, content_id string, url string, title string, embedding array<float>, embedded_at timestamp"
    old = spark.createDataFrame([(0, "a", "ua", "ta", [1.0], None)], schema).drop("seq")
    batch = spark.createDataFrame(
        [(1, "a", "other", "other", [2.0], None), (2, "b", "ub", "tb", [3.0], None), (3, "b", "ux", "tx", [4.0], None)], schema
    )
    rows = {r["content_id"]: (r["url"], r["title"], r["embedding"]) for r in upsert_vectors(old, batch).collect()}
    assert rows == {"a": ("ua", "ta", [2.0]), "b": ("ub", "tb", [4.0])}


def stats_rows(df):
    return sorted((r["section"], r["key"], r["value"]) for r in df.collect())


def facts_batch(spark, rng, n, urls, contents):
    rows = [
        (
            i, f"u{rng.randrange(urls)}", f"c{rng.randrange(contents)}", "t", rng.choice(["p1", "p2", "", None]), rng.choice(["en", "fr", None]),
            rng.choice(["trends", None]), None if rng.random() < 0.2 else f"2026-01-{rng.randint(1, 6):02d} {rng.randint(0, 23):02d}:00:00",
        )
        for i in range(n)
    ]
    schema = "seq bigint, url string, content_id string, title string, publisher_name string, bucket string, signal_type string, date string"
    return _with_payload(spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("timestamp")))


@pytest.mark.parametrize("seed", [2, 5])
def test_kept_stats_equal_a_scan(spark, tmp_path, seed):
    """After every commit, replaced first and last rows of days included, and after compaction."""
    rng = random.Random(seed)
    store = CorpusTable(spark, str(tmp_path / "t"), buckets=4, stats=True)
    for round_ in range(4):
        store.upsert(facts_batch(spark, rng, 40, 25, 60), batch_ts=F.lit(NEW).cast("timestamp"))
        assert stats_rows(store.read_stats()) == stats_rows(corpus_stats(store.read()))
        if round_ == 2:
            store.compact()
            assert stats_rows(store.read_stats()) == stats_rows(corpus_stats(store.read()))


def test_kept_stats_read_states_only(spark, tmp_path):
    store = CorpusTable(spark, str(tmp_path / "t"), buckets=4, stats=True)
    with pytest.raises(RuntimeError):
        store.read_stats()
    rng = random.Random(1)
    for _ in range(3):
        store.upsert(facts_batch(spark, rng, 30, 20, 50))
    want = stats_rows(corpus_stats(store.read()))
    shutil.rmtree(tmp_path / "t" / "rows")
    assert stats_rows(store.read_stats()) == want


def test_stats_of_a_table_that_had_none(spark, tmp_path):
    rng = random.Random(4)
    CorpusTable(spark, str(tmp_path / "t"), buckets=4).upsert(facts_batch(spark, rng, 30, 20, 50))
    store = CorpusTable(spark, str(tmp_path / "t"), buckets=4, stats=True)
    store.upsert(facts_batch(spark, rng, 30, 20, 50))
    assert stats_rows(store.read_stats()) == stats_rows(corpus_stats(store.read()))
    stray = spark.createDataFrame([("total", "", 9, None, None, False)], kept_stats.STATE)
    stray.write.parquet(str(tmp_path / "t" / "stats" / "commit=9"))  # of a commit that failed
    assert stats_rows(store.read_stats()) == stats_rows(corpus_stats(store.read()))


def test_texts_move_once_to_the_rows_that_win(spark):
    """Held stamps and the choice are settled on (seq, url); url and seq may repeat or be null."""
    existing, batch = tables(
        spark, {"a": ("o", "t", OLD)}, [(1, "a", "x", "t"), (2, "a", "y", "t"), (3, None, "z", "t"), (3, "b", "w", "t")]
    )
    changes = corpus_changes(existing, batch, F.lit(NEW).cast("timestamp"))
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {(r["url"], r["content_id"]): (str(r["inserted_at"]), r["is_update"]) for r in changes.collect()}
    assert got[("a", "y")] == (OLD, True) and got[("b", "w")] == (NEW, False)
