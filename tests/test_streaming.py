"""Streams give what the batch gives, in one file or many, once or twice."""

import os

from pyspark.sql import functions as F

from newsloom.catalog.fixtures import articles, corpus
from newsloom.session import shared_dir
from newsloom.sources.tables import CorpusTable
from newsloom.streaming.ingest import dedup_against_corpus, dedup_stream, file_stream, ingest_stream

SMALL = "/root/testdata/sf0.001"


def contents(df):
    return {(r["url"], r["content_id"]) for r in df.select("url", "content_id").collect()}


def run(spark, source, schema, store, checkpoint, per_batch, lines=None, name="articles"):
    stream = file_stream(spark, source, schema, files_per_batch=per_batch)
    ingest_stream(stream, store, name, checkpoint, lambda batch: batch.drop("text"), lines).awaitTermination()


def test_files_and_reruns(spark, tmp_path):
    rows = articles(spark, SMALL)
    want = contents(corpus(spark, SMALL))
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    rows.coalesce(1).write.parquet(one)
    # Sequence order across files, as feeds arrive in order.
    for i, chunk in enumerate(("seq < 70", "seq >= 70 and seq < 140", "seq >= 140")):
        rows.where(chunk).coalesce(1).write.mode("append").parquet(many)
    a = CorpusTable(spark, str(tmp_path / "a"), buckets=4)
    b = CorpusTable(spark, str(tmp_path / "b"), buckets=4)
    run(spark, one, rows.schema, a, str(tmp_path / "ca"), 1)
    run(spark, many, rows.schema, b, str(tmp_path / "cb"), 1, str(tmp_path / "lines"))
    assert contents(a.read()) == want
    assert len(b.read().collect()) == len(want)
    assert {c for _, c in contents(b.read())} == {c for _, c in want}
    assert spark.read.json(str(tmp_path / "lines")).count() == len(want)
    # A stream that lost its checkpoint delivers the same batches again.
    run(spark, one, rows.schema, a, str(tmp_path / "ca2"), 1)
    assert contents(a.read()) == want
    a.compact()
    assert contents(a.read()) == want


def test_two_streams_into_one_table(spark, tmp_path):
    rows = articles(spark, SMALL)
    store = CorpusTable(spark, str(tmp_path / "t"), buckets=4)
    for name, chunk in (("feeds", "seq < 80"), ("api", "seq >= 80")):
        rows.where(chunk).coalesce(1).write.parquet(str(tmp_path / name))
        run(spark, str(tmp_path / name), rows.schema, store, str(tmp_path / f"c-{name}"), 1, name=name)
    want = contents(corpus(spark, SMALL))
    assert contents(store.read()) == want
    run(spark, str(tmp_path / "api"), rows.schema, store, str(tmp_path / "c-again"), 1, name="api")
    assert contents(store.read()) == want


def test_batches_leave_no_working_folders(spark, tmp_path):
    rows = articles(spark, SMALL)
    rows.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = os.path.join(shared_dir(spark), "newsloom")
    before = set(os.listdir(kept))
    run(spark, str(tmp_path / "in"), rows.schema, CorpusTable(spark, str(tmp_path / "t"), buckets=4), str(tmp_path / "c"), 1)
    assert set(os.listdir(kept)) == before


def test_dedup_against_corpus_keeps_the_first(spark):
    items = spark.createDataFrame(
        [(2, "https://a.com/x#late"), (1, "https://A.com/x"), (3, "https://b.com/"), (0, "https://c.com/seen")], "pos int, url string"
    )
    known = spark.createDataFrame([("https://c.com/seen?utm_source=q",)], "url string")
    kept = dedup_against_corpus(items, known, [F.col("pos")]).orderBy("pos").collect()
    assert [r["pos"] for r in kept] == [1, 3]


def test_dedup_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (["https://a.com/x", "HTTPS://A.com/x#1"], ["https://a.com/x?utm_source=z", "https://b.com"]):
        spark.createDataFrame([(u,) for u in part], "url string").coalesce(1).write.mode("append").parquet(source)
    stream = file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    (
        dedup_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .option("path", out).trigger(availableNow=True).start().awaitTermination()
    )
    got = [r[0] for r in spark.read.parquet(out).select(F.col("url_norm")).collect()]
    assert sorted(got) == ["https://a.com/x", "https://b.com/"]
