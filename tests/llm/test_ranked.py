import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import ranked
from newsloom.session import materialize
from tests.llm.frames import frame, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, limit):
    known = [(i, Counter(terms(t))) for i, t, *_ in docs if i is not None and terms(t)]
    n, words = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(w for _, c in known for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    rows = []
    for item, own in asked.items():
        scores = []
        for i, c in known:
            m = 50 + 50 * sum(c.values()) * n // words
            parts = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in own if w in c]
            if sum(parts) > 0:
                scores.append((-sum(parts), i))
        rows += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:limit], 1)]
    return Counter(rows)


def questions(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "'x' as term")


def check(spark, docs, items, limit=5, words=300, per_block=4, window=16, parts=3):
    index = materialize(ranked.build_index(frame(spark, docs).repartition(parts), words, per_block), "test-index")
    got = ranked.search(index, questions(spark, items), limit, window).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == plain(docs, items, limit)


def vocabulary_rows(seed, n):
    """Texts over few words, so that lists are long and scores tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("window", [3, 16, 1000])
def test_same_as_scoring_all(spark, window):
    docs = vocabulary_rows(1, 300) + [(1000 + i, "w3 w7, W29") for i in range(30)]
    items = [(1, "w0 w1 w2"), (2, "w29 w28 w27 w0"), (3, "W5-w6;w7"), (4, None), (5, "unknown"), (6, "w29"), (7, ""), (7, "w3 w4"), (7, "w4 w5")]
    check(spark, docs, items, window=window)


def test_odd_rows(spark):
    docs = odd_rows() + [(200, "café CAFÉ É 東京 x-y_z"), (201, "😀 1 2 3"), (None, "text here")]
    items = [(1, "naïve café 東京 É"), (2, prose(1, 30)), (None, "text here"), (3, "x z 1 😀")]
    check(spark, docs, items, limit=50)


def test_repeated_documents_are_ranked_each(spark):
    check(spark, [(5, "a b"), (5, "a b"), (4, "a b"), (6, "c")] * 3, [(1, "a"), (2, "a a b")], limit=4)


def test_empty(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])):
        found = ranked.ranked_search(frame(spark, docs), questions(spark, items))
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 2**k, 50) for k in (1, 7, 8, 14, 15, 31)]).astype(np.int64)
    body, ends = ranked.pack(values, np.array([10, 10, 300]))
    assert ranked.unpack(body.tobytes()).tolist() == values.tolist()
    assert ranked.unpack(body[: ends[0]].tobytes()).tolist() == values[:10].tolist() and ends[0] == ends[1]


def test_blocks_are_left_packed(spark):
    """A rare term decides: the blocks of a common one are opened only where they can matter."""
    rng = random.Random(3)
    docs = [(i, "common " * (1 + i % 3) + " ".join(rng.choices("abcdefgh", k=20))) for i in range(4000)]
    docs = [(i, t + (" rare" if i % 100 == 0 else "")) for i, t in docs]
    index = ranked.build_index(frame(spark, docs).coalesce(1), 10**9, 16).toPandas()
    lists = ranked.Lists(index, len(docs), sum(len(terms(t)) for _, t in docs))
    ranked.best_rows(lists, [("rare", 8000), ("common", 3)], 5, 512)
    start, end = lists.spans["common"]
    opened = [n for n in lists.open if start <= n < end]
    assert 0 < len(opened) <= 80 < end - start
