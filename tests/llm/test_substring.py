import hashlib
from collections import Counter

import numpy as np

from newsloom.llm import substring
from newsloom.llm.wordhash import least_in, run_hashes, span_hashes, word_hashes
from tests.llm.frames import frame, odd_rows, prose


def plain(rows, window):
    seen = Counter()
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for _, words in texts:
        seen.update(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages():
    """A shared passage in many places, two of its parts alone, a run of one word, self-repeats."""
    shared = prose(9, 90).split()
    rows = []
    for i in range(30):
        own = prose(900 + i, 80).split()
        part = shared if i % 3 == 0 else shared[20:60] if i % 3 == 1 else shared[:34]
        rows.append((1000 + i, " ".join(own[: i * 2] + part + own[i * 2 :])))
    rows.append((2000, "word " * 200))
    rows.append((2001, prose(77, 50) + " " + prose(78, 3) + "\n" + prose(77, 50)))
    rows.append((2002, " ".join(shared[:45] + ["other"] + shared[46:])))
    rows.append((2003, " ".join(shared[10:45])))
    return rows


def test_windows(spark):
    rows = odd_rows() + passages()
    for window, gram in ((35, 8), (12, 3)):
        got = substring.digest_of_rest(frame(spark, rows), window, gram).collect()
        fields = ("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(tuple(r[f] for f in fields) for r in got) == plain(rows, window)


def test_texts_and_factors(spark):
    rows = passages()
    for r in substring.remove_repeats(frame(spark, rows)).collect():
        words = dict(rows)[r["doc_id"]].split()
        gone = set()
        for f in r["factors"]:
            assert f["length"] >= 35
            gone |= set(range(f["start"], f["start"] + f["length"]))
        assert len(gone) == r["n_removed"]
        assert r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_repeated_rows_list_their_blocks_once(spark):
    rows = [(None, prose(5, 400))] * 60 + [(3, prose(5, 400))] * 2 + [(4, prose(6, 100))]
    found = substring.repeated_windows(frame(spark, rows), 35, 8).collect()
    assert found and all(len(r["listed"]) == len(set(r["listed"])) <= 400 for r in found)
    got = substring.digest_of_rest(frame(spark, rows)).collect()
    assert Counter(tuple(r[f] for f in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got) == plain(rows, 35)


def test_empty(spark):
    assert substring.digest_of_rest(frame(spark, [])).count() == 0
    assert substring.digest_of_rest(frame(spark, [(1, None), (2, "a b")])).count() == 2


def test_hashes_depend_on_words_only():
    a, b = prose(1, 100).encode().split(), prose(2, 60).encode().split()
    h, g = word_hashes(a), word_hashes(b + a)
    for n in (1, 2, 7, 8, 35):
        assert (run_hashes(h, n) == run_hashes(g, n)[60:]).all()
    starts, ends = np.array([0, 5]), np.array([40, 99])
    assert (span_hashes(h, starts, ends) == span_hashes(g, starts + 60, ends + 60)).all()
    values = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    upper = values >> np.uint64(32)
    assert least_in(values, 28).tolist() == [i + int(upper[i : i + 28].argmin()) for i in range(273)]
