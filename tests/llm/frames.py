"""Small tables for the tests of the llm operators."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # extra columns under names that operators use inside
    "size long, key string, block int, shard string, mark int, doc string, score double, fp long, digest string"
)


def row(doc_id, text, source="a"):
    extra = (1, "k", 2, "s", 3, "d", 0.5, 7, "x")
    return (doc_id, text, "en", source, None if text is None else len(text), *extra)


def frame(spark, rows):
    """A stored-like frame of (doc_id, text[, source]) rows."""
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(words))


def odd_rows():
    """Nulls, empty, blank and long texts, copies, repeated rows, repeated and null ids, hot source."""
    base = prose(1, 120)
    rows = [
        (1, None, "a"), (2, "", None), (3, " \t\n\x0b\x0c\r ", "a"), (4, base, "a"), (5, base, "b"), (5, base, "b"),
        (None, base + "  ", "é"), (None, None, None), (6, base.replace(" ", "\n"), "a"), (6, prose(2, 60), "a"),
        (7, prose(3, 4000), "a"), (8, prose(4, 60) + " " + base, "Z"), (9, "naïve 😀 text here  ", "a"),
        (10, "x" * 5000, "a"), (-3, base[:-1] + "z", "a"),
    ]
    return rows + [(100 + i, base if i % 2 else f"{prose(50 + i, 40)}", "a") for i in range(20)]
