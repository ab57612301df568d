"""Known URLs behind filters against the plain anti-join."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators.joins import anti_join_seen
from newsloom.operators.seen_urls import SeenUrls, let_through, made_filter


def urls(spark, numbers):
    rows = [(i, None if n is None else f"https://h{n % 7}.com/{n}") for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "i int, url_norm string")


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_same_as_the_anti_join(spark, tmp_path, bits):
    """With filters that let nearly all through, and with good ones, over three commits, one of them repeated."""
    table = SeenUrls(spark, str(tmp_path / "seen"), ranges=4, bits=bits)
    candidates = urls(spark, [*range(0, 400, 3), *range(0, 60, 3), None, None])
    assert table.unseen(candidates).count() == candidates.count()
    known = None
    for commit, numbers in enumerate([range(0, 100), range(50, 150), [None, 300, 300], range(50, 150)]):
        part = urls(spark, numbers)
        table.add(part, min(commit, 2) if commit < 3 else 1)
        known = part if known is None else known.unionByName(part)
        want = sorted(r["i"] for r in anti_join_seen(candidates, known).collect())
        assert sorted(r["i"] for r in table.unseen(candidates).collect()) == want
        assert table.unseen(candidates).columns == ["url_norm", "i"]


def test_ranges_without_a_candidate_stay_closed(spark, tmp_path):
    table = SeenUrls(spark, str(tmp_path / "seen"), ranges=8, bits=1 << 14)
    table.add(urls(spark, range(1000)), 1)
    assert table.passed(urls(spark, range(5000, 5100))).count() <= 2
    plan = table.seen(urls(spark, [3]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = \d+\)", plan)
    assert [r[0] for r in table.seen(urls(spark, [3, 3, 7000])).collect()] == ["https://h3.com/3"]


def test_filter_holds_what_was_put_in():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64)
    body = made_filter(keys, 1 << 18, 6)
    assert let_through(keys, body, 6).all()
    assert let_through(rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64), body, 6).mean() < 0.02


def test_few_candidates_reach_the_known_urls(spark, tmp_path):
    table = SeenUrls(spark, str(tmp_path / "seen"), ranges=4, bits=1 << 16)
    table.add(urls(spark, range(2000)), 1)
    candidates = urls(spark, range(1900, 6000))
    assert 100 <= table.passed(candidates).count() <= 140
    assert table.unseen(candidates).agg(F.count("*")).first()[0] == 4000
