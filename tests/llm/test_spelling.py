import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import spelling
from newsloom.session import materialize
from tests.llm.frames import frame, odd_rows, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs, least=6, times=5):
    found = Counter()
    for i, text, *_ in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= times}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(docs, **more):
    words = plain_words(docs, **more)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def check(spark, docs):
    got = spelling.spelling_variants(frame(spark, docs).repartition(3)).collect()
    want = plain(docs)
    assert Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got) == want
    return want


def variants(seed, n, letters="abcdeé"):
    """Words of few letters and their one-letter variants, some of them in chains of growing counts."""
    rng, words = random.Random(seed), []
    while len(words) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        times = rng.choice([5, 6, 30])
        for _ in range(rng.randint(1, 4)):
            words.append((word, times))
            at, times = rng.randrange(len(word)), min(times * rng.choice([1, 5, 6]), 900)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + "z" + word[at + 1 :]])
    return words


def test_same_as_comparing_all(spark):
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(variants(1, 250))]
    want = check(spark, rows)
    assert any(form and root != form for _, form, root, *_ in want)


def test_odd_rows(spark):
    docs = odd_rows() + [(i, "Grüße GRÜßE ÉCOLE École × a÷bcdefg naïvely,NAÏVELY " + "y" * 3000) for i in range(300, 306)]
    docs += [(None, "lettered lettering"), (None, "lettered lettering")] * 4
    check(spark, docs)


def test_one_in_199_runs_loses_a_letter(spark):
    rows = [(i, "aaaaaaaa") for i in range(4000)]
    want = {w: n for w, _, _, n, *_ in check(spark, rows)}
    assert 5 <= sum(n for w, n in want.items() if w != "aaaaaaaa") <= 60


def test_empty(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, ""), (3, "one two")])).count() == 0


@pytest.mark.parametrize("most", [7, 4_000])
@pytest.mark.parametrize("lengthened", [2, 50, 4_000])
def test_no_pair_is_lost(spark, most, lengthened):
    """Dictionaries with many and with no longer grams, words of any length, groups split in blocks."""
    rng = random.Random(lengthened)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"x" * 40, "x" * 41}
    stored = materialize(spark.createDataFrame([(w,) for w in words], "word string"), "test-words")
    got = {(r["word"], r["near"]) for r in spelling.near_words(stored, lengthened=lengthened, most=most).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_grams_that_stay():
    """The bound holds for every edit of a word, with any dictionary."""
    rng = random.Random(9)
    for _ in range(300):
        alphabet = "abc"
        pool = {"".join(rng.choice(alphabet) for _ in range(n)).encode() for n in (2, 2, 2, 3, 3, 3) for _ in range(3)}
        lengthened = frozenset(g for g in pool if len(g) == 2 or g[:-1] in pool)
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10)))
        cut = lambda w: [w[s:e] for s, e in spelling.decomposed(w, lengthened, 2, 4)]
        own = spelling.marked(word)
        bound = spelling.least_common(spelling.decomposed(own, lengthened, 2, 4), len(own), 4)
        assert bound >= 1
        for at in range(len(word) + 1):
            edits = [word[:at] + c + word[at:] for c in alphabet] + [word[:at] + c + word[at + 1 :] for c in ["", *alphabet] if at < len(word)]
            for other in edits:
                shared = Counter(cut(own)) & Counter(cut(spelling.marked(other)))
                assert other == word or sum(shared.values()) >= bound


def test_group_in_blocks_compares_across_only():
    words = ["abcdef", "abcdeg", "abcdefg", "zzzzzz"]
    grams, ends = np.array([1, 2, 1, 2, 1, 2, 9]), np.array([2, 4, 6, 7])
    pairs = lambda side, split: sorted(zip(*(x.tolist() for x in spelling.near_in_group(words, np.ones(4, int), ends, grams, np.array(side), split))))
    assert pairs([0, 0, 0, 0], False) == [(0, 1), (0, 2), (1, 2)]
    assert pairs([0, 0, 1, 1], True) == [(0, 2), (1, 2)]
