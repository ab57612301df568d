import random
import zlib

import pytest

from newsloom.llm import toxicity
from tests.llm.frames import frame, odd_rows, prose


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(1)
    terms = ["idiot", "worthless", "scum", "banana", "abcde", "aabbaab"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), {})
    for _ in range(4000):
        word = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice("abcdeio") for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randrange(3)):
            kind, at = rng.randrange(3), rng.randrange(len(word) + 1)
            if kind == 0:
                word.insert(at, rng.choice("abcx"))
            elif word and at < len(word):
                word[at : at + 1] = [] if kind == 1 else [rng.choice("abcx")]
        word = "".join(word)
        near = any(len(t) >= 5 and edits(word, t) <= 1 for t in terms)
        assert lexicon.near(word) == (near and len(word) >= 4), word
        if lexicon.near(word):
            assert lexicon.candidate(word), word


def test_stems_match_beginnings():
    lexicon = toxicity.Lexicon({}, {"lowei": 2.0})
    assert lexicon.exact("loweischaft") and not lexicon.exact("flowei")
    assert lexicon.near("lo0eischaft") and lexicon.near("oweischaft") and not lexicon.near("lauterbach")


def test_quotation_is_set_apart():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    made = lambda t: toxicity.features(t, lexicon, {})
    assert made("you are an idiot today")[0] > 0 and made("you are an idiot today")[2] == 0
    assert made('the sign read "what an idiot" in red')[0] == 0 and made('the sign "an idiot" x')[2] > 0
    assert made("they said idiot is a strange word")[2] > 0
    assert made("an id1ot here")[1] > 0
    assert made("") == made(None) == [0.0] * toxicity.FEATURES


def labelled(n=500):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        words, toxic = prose(i + 10_000, 60).split(), int(i % 5 == 0)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(60)] = rng.choice(["grumphen", "zarkle", "vorpo" + rng.choice(["la", "ni", "sk", "rt", "em", "ux", "yd"])])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = labelled()
    labels_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, labels, labels_


def test_held_out_rows_are_told_apart(spark, learned):
    rows, labels, labels_ = learned
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), labels_).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    right = sum(got[i]["predicted"] == truth[i] for i in held)
    assert right >= 0.97 * len(held) and sum(truth[i] for i in held) > 10
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_held_out_labels_and_other_columns_do_not_matter(spark, learned):
    rows, labels, _ = learned
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    tables = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, flipped)]
    a, b = (toxicity.fit(frame(spark, rows), t) for t in tables)
    assert a == b


def test_odd_rows_and_no_labels(spark, learned):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(frame(spark, []), learned[2]).count() == 0
    repeated = learned[2].unionByName(learned[2])
    left = toxicity.drop_toxic(frame(spark, learned[0] + odd_rows()), repeated)
    assert left.columns == docs.columns and left.where("doc_id is null").count() == 2
    assert toxicity.toxicity(frame(spark, [(1, "you idiot, you moron, you idiot")]), none).first()["predicted"] == 1


def test_copies_teach_no_words(spark):
    """A toxic text with many copies does not make its ordinary words terms."""
    rows, labels = labelled(200)
    copy = prose(77, 50)
    rows += [(1000 + i, copy) for i in range(60)]
    labels += [(1000 + i, 1, 1) for i in range(60)]
    labels_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    words, _ = toxicity.learn_terms(toxicity.labelled_sample(frame(spark, rows), labels_, 1000), least=3, texts=3)
    assert not set(copy.split()) & set(words) and "grumphen" in words
