import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.llm.components import connected
from tests.llm.frames import frame, odd_rows, prose


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance=4):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    unique = sorted(set(prints))
    for i, a in enumerate(unique):
        for b in unique[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    low: dict = {}
    for p, i in zip(prints, ids):
        if i is not None:
            low[root(p)] = min(i, low.get(root(p), i))
    return [low.get(root(p)) for p in prints]


def test_near_duplicates(spark):
    rng, rows = random.Random(3), odd_rows()
    for i in range(40):  # near copies: one word of a long text changed
        words = prose(i % 4, 400).split()
        words[rng.randrange(400)] = "changed"
        rows.append((500 + i, " ".join(words).upper() if i % 2 else "\n".join(words)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [plain_print(t) for _, t, *_ in rows]
    low = plain_components(prints, [r[0] for r in rows])
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, low))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(low) | {None} if None in low else set(low))


@pytest.mark.parametrize("most", [3, 20, 10_000])
@pytest.mark.parametrize("segments", [2, 3, 4])
def test_links_lose_nothing(spark, most, segments):
    """Fingerprints in a few tight clouds, so that values are crowded and blocks are split."""
    rng = random.Random(segments)
    prints = []
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            prints.append(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    signed = np.array(sorted(set(prints)), np.uint64).view(np.int64).tolist()
    frame_ = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    links = simhash.fingerprint_links(frame_, 4, segments, most)
    unsigned = lambda x: x % 2**64
    found = {unsigned(r["node"]): unsigned(r["root"]) for r in connected(links).collect()}
    unique = sorted(set(prints))
    want = plain_components(unique, unique)
    groups = {}
    for p, c in zip(unique, want):
        groups.setdefault(c, set()).add(p)
    got = {}
    for p in unique:
        got.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[1000 + i] for i in range(60)} == {1000}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0
