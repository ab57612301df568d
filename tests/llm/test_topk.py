import math
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score double, rank string, leaf int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "x", 3) for i, v in rows], SCHEMA)


def brute(rows, wanted, k):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = defaultdict(list)
    queries = {}
    for i, v in usable:
        if wanted(i):
            queries[i] = min(v, queries.get(i, v))
    for i, q in queries.items():
        scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i]
        out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def run(spark, rows, k=5, **more):
    vectors = table(spark, rows)
    got = defaultdict(list)
    for r in sorted(topk.exact_topk(vectors, vectors.where("vec_id % 20 = 0"), k, **more).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


@pytest.mark.parametrize("leaves, block_rows", [(1, 1000), (8, 30), (32, 7)])
def test_equals_brute_force(spark, leaves, block_rows):
    rng = np.random.default_rng(leaves)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # a hot vector
    got = run(spark, rows, leaves=leaves, block_rows=block_rows, sample_rows=64)
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_pruning_drops_pairs_but_no_result():
    rng = np.random.default_rng(3)
    points = np.concatenate([1000 * c + rng.integers(-20, 20, (50, 4)) for c in rng.normal(size=(10, 4))]).astype(np.int64)
    tree = topk.CoverTree.over(points[::5], 10)
    leaf, away = tree.file(points)
    radius = {int(n): float(away[leaf == n].max()) for n in np.unique(leaf)}
    best = np.sort(points @ points.T, axis=1)[:, -6]
    worst = {n: float(best[leaf == n].min()) for n in radius}
    tree.spread(radius, radius, worst)
    pairs = set(tree.pairs())
    assert len(pairs) < len(radius) ** 2 / 2
    scores = points @ points.T
    for q, d in zip(*np.nonzero(scores > best[:, None])):
        assert (leaf[q], leaf[d]) in pairs


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, [0.5]), (120, []), (None, [1.0, 1.0]),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (140, [-1.0, 0.01]), (140, [3.0, 3.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 20 == 0, 5)
    assert run(spark, []) == {} and run(spark, [(20, None)]) == {} and run(spark, [(20, [1.0])]) == {}


def test_large_numbers(spark):
    rows = [(20, [1e7, -1e7]), (1, [1e7, 1.0]), (2, [3.0, 1e7]), (3, [1e7, 1.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 20 == 0, 5)
