"""Duplicate rates of a stream against those of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.aggregates import page_dup_rate, rolling_dup_rate
from newsloom.streaming.rates import read_rates, stream_dup_rate, write_rates

SCHEMA = "bucket string, page bigint, accepted boolean"


def items(seed, buckets=("en", "fr"), pages=14):
    rng = random.Random(seed)
    rows = []
    for bucket in buckets:
        for page in range(pages):
            share = rng.random()
            rows += [(bucket, page * 3, rng.random() < share) for _ in range(rng.randint(1, 6))]
    return rows


def whole(spark, rows):
    return {tuple(r) for r in rolling_dup_rate(page_dup_rate(spark.createDataFrame(rows, SCHEMA))).collect()}


def land(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, out, checkpoint, **more):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    write_rates(stream_dup_rate(source, **more), out, checkpoint).awaitTermination()


@pytest.mark.parametrize("shuffled", [False, True])
def test_any_split_and_a_restart(spark, tmp_path, shuffled):
    rows = items(3)
    if shuffled:
        random.Random(1).shuffle(rows)
    cuts = [0, 9, 20, 21, len(rows) // 2, len(rows)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    land(spark, folder, parts[:3])
    drain(spark, folder, out, checkpoint)
    assert {tuple(r) for r in read_rates(spark, out).collect()} == whole(spark, rows[: cuts[3]])
    land(spark, folder, parts[3:])
    drain(spark, folder, out, checkpoint)  # goes on from the checkpoint
    assert {tuple(r) for r in read_rates(spark, out).collect()} == whole(spark, rows)
    drain(spark, folder, out, checkpoint)  # nothing is read twice
    assert {tuple(r) for r in read_rates(spark, out).collect()} == whole(spark, rows)


def test_forgotten_pages(spark, tmp_path):
    """State holds the last pages only; what comes for earlier ones is told as late."""
    rows = items(5, buckets=("en",), pages=20)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    in_order = [[r for r in rows if r[1] // 3 // 5 == k] for k in range(4)]
    land(spark, folder, in_order)
    drain(spark, folder, out, checkpoint, kept=6)
    want = whole(spark, rows)
    assert {tuple(r) for r in read_rates(spark, out).collect()} == want
    land(spark, folder, [[("en", 0, True), ("en", 0, False), ("en", 1, True)]])
    drain(spark, folder, out, checkpoint, kept=6)
    assert {tuple(r) for r in read_rates(spark, out).collect()} == want
    late = spark.read.parquet(out).where("late > 0").groupBy("page").agg(F.sum("late").alias("n")).collect()
    assert {(r["page"], r["n"]) for r in late} == {(0, 2), (1, 1)}


def test_nothing_arrived(spark, tmp_path):
    assert read_rates(spark, str(tmp_path / "none")).count() == 0
