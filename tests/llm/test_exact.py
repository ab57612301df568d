import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import exact, fuse
from newsloom.session import materialize
from pyspark.sql import functions as F
from tests.llm.frames import frame, odd_rows, prose


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys[:5]]))
    assert fuse.contains(keys, *made).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert fuse.contains(others, *made).mean() < 0.02
    assert len(made[3]) < 1.4 * n + 2000


def plain(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        text = text or ""
        digest = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()
        groups[digest].append((i, len(text)))
    out = []
    for digest, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        left = 1
        for i, n in members:
            kept = (i, n) == keep and left == 1
            left -= kept
            out.append((i, keep[0], len(members), kept, digest))
    return out


FIELDS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_groups(spark, batches):
    rows = odd_rows() + [(i, prose(i % 9, 5)) for i in range(200, 260)]
    batch = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(batches)).cast("int")
    got = exact.exact_duplicates(frame(spark, rows), batch, batches).collect()
    assert Counter(tuple(r[f] for f in FIELDS) for r in got) == Counter(plain(rows))


def test_default_batches_and_many_buckets(spark, monkeypatch):
    rows = odd_rows() + [(i, prose(i % 40, 3)) for i in range(300, 400)]
    monkeypatch.setattr(exact.merged_groups, "__defaults__", (7,))
    got = exact.exact_duplicates(frame(spark, rows)).collect()
    assert Counter(tuple(r[f] for f in FIELDS) for r in got) == Counter(plain(rows))


def test_drop_duplicates(spark):
    docs = frame(spark, odd_rows())
    left = exact.drop_duplicates(docs)
    assert left.columns == docs.columns
    want = Counter((i, d) for i, _, _, kept, d in plain(odd_rows()) if kept)
    digest = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
    assert Counter((r["doc_id"], digest(r["text"])) for r in left.collect()) == want


def test_empty(spark):
    assert exact.exact_duplicates(frame(spark, [])).count() == 0
    assert exact.drop_duplicates(frame(spark, [])).count() == 0


def test_a_large_batch_on_a_small_snapshot_is_dealt_over_buckets(spark, monkeypatch):
    rows = [(-(10**9), "first")] + [(i, f"text {i % 50}") for i in range(60)] + [(99, "first")]
    docs, used, screen = frame(spark, rows), [], exact.screen
    monkeypatch.setattr(exact, "screen", lambda new, filters, n: used.append(n) or screen(new, filters, n))
    made = materialize(exact.digests(docs, exact.halves(docs).alias("batch")), "test-digests")
    groups = exact.merged_groups(made, docs, 2, keys_per_bucket=10).collect()
    assert used == [6] and sorted(r["n"] for r in groups) == [1] * 40 + [2] * 11
