import zlib
from collections import Counter, defaultdict

from newsloom.llm import sharding
from tests.llm.frames import frame, odd_rows, prose


def check(got, rows, shards=8):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark):
    check(sharding.shard_documents(frame(spark, odd_rows()), rows_per_block=4).collect(), odd_rows())


def test_near_equal_and_groups_together(spark):
    rows = [(i, prose(i // 3, 5 + i // 3 % 20)) for i in range(3000)]
    got = sharding.shard_documents(frame(spark, rows), tolerance=0.02, rows_per_block=100).collect()
    check(got, rows)
    size, homes = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 8
    assert max(abs(s - mean) for s in size.values()) < 0.05 * mean
    assert max(len(h) for h in homes.values()) == 1


def test_a_hot_group_and_repeated_rows_are_split(spark):
    for rows in ([(i, "same text") for i in range(2000)], [(7, "same text")] * 2000):
        got = sharding.shard_documents(frame(spark, rows), rows_per_block=100).collect()
        check(got, rows)
        size = Counter(r["shard"] for r in got)
        assert len(size) == 8 and max(size.values()) - min(size.values()) <= 6


def test_empty_and_few(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    check(sharding.shard_documents(frame(spark, [(1, "a"), (2, None)])).collect(), [(1, "a"), (2, None)])


def test_write_shards(spark, tmp_path):
    docs = frame(spark, odd_rows())
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4, files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(odd_rows()) and set(back.columns) == set(docs.columns)
