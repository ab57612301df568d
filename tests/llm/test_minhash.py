import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import minhash
from tests.llm.frames import frame, odd_rows, prose


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def plain_components(rows, percent=80):
    """Smallest id reachable of each row, over all pairs of sets."""
    sets = [plain_set(t) for _, t, *_ in rows]
    unique = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    parent = {s: s for s in unique}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(unique):
        for b in unique[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(a)] = root(b)
    low = {}
    for (i, *_), s in zip(rows, sets):
        if s and i is not None:
            low[root(s)] = min(i, low.get(root(s), i))
    return [(r[0], len(s), low.get(root(s)) if s else r[0]) for r, s in zip(rows, sets)]


def edited(words, share, rng):
    return " ".join(w if rng.random() > share else f"w{rng.randrange(10**6)}" for w in words)


def check(spark, rows, **more):
    got = minhash.near_duplicates(frame(spark, rows), **more).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(plain_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("most", [1_500, 2_000_000])
def test_near_duplicates(spark, most):
    """Copies around the threshold of several texts, a dense group, short texts; blocks of one and of many tasks."""
    rng, rows = random.Random(5), odd_rows()
    for group in range(6):
        words = prose(900 + group, 60 + 40 * group).split()
        rows += [(1000 + 100 * group + i, edited(words, rng.choice([0, 0.02, 0.04, 0.06, 0.1]), rng)) for i in range(12)]
    dense = prose(77, 150).split()
    rows += [(3000 - i, edited(dense, 0.05, rng).upper()) for i in range(60)]
    rows += [(4000 + i, t) for i, t in enumerate(["one", "ONE", "one two", "two one", "one two three", "one  two\nthree"])]
    check(spark, rows, most=most)


def test_chain_of_edits(spark):
    """Neighbours of a chain are linked, its ends are far apart: one component all the same."""
    words = prose(8, 200).split()
    rows = []
    for i in range(24):
        words[8 * i] = f"new{i}"
        rows.append((50 - i, " ".join(words)))
    check(spark, rows)
    assert {c for *_, c in plain_components(rows)} == {27}


def test_repeated_rows_and_null_ids(spark):
    text = prose(3, 50)
    check(spark, [(None, text)] * 40 + [(None, text + " more")] * 3 + [(7, None)] * 3)


def test_empty(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    check(spark, [(1, None), (2, ""), (3, " \n")])


def test_signature_holds_least_and_greatest():
    rng = np.random.default_rng(2)
    factors = minhash.multipliers(10)
    items = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    whole, parts = minhash.signature(items, factors), [minhash.signature(p, factors) for p in np.array_split(items, 7)]
    assert (whole[:, 0] == np.min([p[:, 0] for p in parts], axis=0)).all()
    assert (whole[:, 1] == np.max([p[:, 1] for p in parts], axis=0)).all()


def test_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    factors = minhash.multipliers(2000)
    items = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    a, b = minhash.signature(items[:800], factors), minhash.signature(items[100:], factors)
    assert abs((a == b).mean() - 700 / len(items)) < 0.03
    assert minhash.missed_share(0.8) < 1e-6
