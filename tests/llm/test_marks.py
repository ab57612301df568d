"""Rows of one id, here null, whose texts agree in Spark's 32-bit hash."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import exact, simhash, substring
from tests.llm.frames import frame, prose

A, B = f"{prose(901, 45)} 10269", f"{prose(902, 45)} 173157"
ROWS = [(1, A), (None, A), (None, B)]


def test_the_texts_agree_in_the_short_hash(spark):
    hashes = frame(spark, ROWS[1:]).select(F.hash("text").alias("h")).distinct()
    assert hashes.count() == 1


@pytest.mark.parametrize("drop", [exact.drop_duplicates, simhash.drop_near_duplicates])
def test_no_clean_row_is_dropped_with_another(spark, drop):
    assert {(r["doc_id"], r["text"]) for r in drop(frame(spark, ROWS)).collect()} == {(1, A), (None, B)}


def test_no_words_are_removed_for_another_text(spark):
    got = substring.remove_repeats(frame(spark, ROWS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in got) == [(0, 0, B), (0, 46, ""), (1, 46, "")]
