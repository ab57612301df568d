"""Substring deduplication by hashes of blocks and windows.

Every text is cut into overlapping blocks at its minimizers: the windows of ``window`` words
that share their least ``gram``-word hash form a block, and equal windows of any two texts lie
in blocks of equal least hash. All blocks are indexed. A block that occurs elsewhere as a
whole is settled with one look-up; where blocks of one hash differ, at the ends of shared
passages, their windows are compared one by one. A text's factors are the runs of windows that
occur elsewhere, in one text or several; this replaces a relative Lempel-Ziv parse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_batches, text_mark
from newsloom.llm.wordhash import FACTORS, least_in, run_hashes, span_hashes, word_hashes, words_of
from newsloom.session import materialize

WINDOW = 35
GRAM = 8


def blocks_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(least hash, hash of all its words, first window, number of windows) of each block."""
    hashed = word_hashes(words)
    if len(hashed) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = run_hashes(hashed, gram)
    least = least_in(grams, window - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    n = np.diff(np.append(start, len(least)))
    return grams[least[start]], span_hashes(hashed, start, start + n + window - 1), start, n


def blocks(docs: DataFrame, window: int, gram: int, whole: bool) -> DataFrame:
    """One row (h, and if ``whole`` s, doc_id, mark, start, n) for each block of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                made = blocks_of(words_of(text), window, gram)
                if len(made[0]):
                    rows.append(np.full(len(made[0]), row))
                    found.append(made)
            if not found:
                continue
            h, s, start, n = (np.concatenate(x) for x in zip(*found))
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
                continue
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(h.view(np.int64)), pa.array(s.view(np.int64))]
            columns += [batch.column(0).take(at), batch.column(1).take(at)]
            columns += [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "s", "doc_id", "mark", "start", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"h bigint, s bigint, doc_id {kind}, mark binary, start int, n int" if whole else "h bigint"
    return in_batches(docs).select("doc_id", text_mark(), "text").mapInArrow(run, schema)


def windows_of_blocks(texts: DataFrame, window: int) -> DataFrame:
    """(h, w, s, at, times): the windows of listed blocks; equal windows agree in h and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = run_hashes(word_hashes(words_of(text)), window, FACTORS[1])
                start, n, h, s, times = (np.array([b[k] for b in listed]) for k in ("start", "n", "h", "s", "times"))
                block = np.repeat(np.arange(len(listed)), n)
                at = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
                w = hashes[start[block] + at].view(np.int64)
                arrays = [h[block], w, s[block], at.astype(np.int32), times[block]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["h", "w", "s", "at", "times"])

    return in_batches(texts).mapInArrow(run, "h bigint, w bigint, s bigint, at int, times bigint")


def _by_text(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per text with its blocks, each once however often the text is repeated; no longer than the text."""
    return rows.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set(F.struct(*fields)).alias("listed")
    )


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per text (_id, _mark) the blocks with windows that occur elsewhere.

    ``listed`` holds (start, mask): bit i of the mask is set if the window that starts at word
    ``start + i`` occurs at another place too. A block has at most ``window - gram + 1`` windows.
    """
    often = blocks(docs, window, gram, False).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    often = materialize(often, "substring-often")  # stored, so that the join can split a hot hash
    hits = materialize(blocks(docs, window, gram, True).join(often, "h", "left_semi"), "substring-blocks")
    first = F.min(F.struct("doc_id", "mark", "start"))
    kinds = hits.groupBy("h", "s").agg(F.count(F.lit(1)).alias("times"), first.alias("first"), F.min("n").alias("n"))
    kinds = materialize(kinds, "substring-kinds")
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    mixed = materialize(mixed, "substring-mixed")
    same = kinds.join(mixed, "h", "left_anti").select("h", "s", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    apart = kinds.join(mixed, "h", "left_semi").select("h", "s", "times", "n", "first.*")
    listed = _by_text(apart, "start", "n", "h", "s", "times")
    texts = docs.select("doc_id", text_mark(), "text").join(listed.hint("shuffle_hash"), _same_text())
    # rows that repeat both id and text give their windows again; such blocks have times > 1 as it is
    pieces = materialize(windows_of_blocks(texts.select("text", "listed"), window), "substring-windows")
    twice = pieces.groupBy("h", "w").agg(F.sum("times").alias("t")).where("t > 1").select("h", "w")
    bit = F.expr("bit_or(shiftleft(1L, at))")
    partly = pieces.join(twice, ["h", "w"], "left_semi").groupBy("h", "s").agg(bit.alias("mask"))
    masks = materialize(same.unionByName(partly), "substring-masks")
    return _by_text(hits.join(masks, ["h", "s"]), "start", "mask")


def factors(n_words: int, listed: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """The duplicate spans (first word, end) of a text, left to right.

    A factor grows while the next window occurs elsewhere too; at its end the search goes on
    with the windows that overlap it, so that a factor may follow on, or overlap, the last.
    """
    if not listed or n_words < window:
        return []
    repeated = np.zeros(n_words - window + 1, bool)
    for block in listed:
        bits = np.flatnonzero(np.unpackbits(np.array([block["mask"]], "<i8").view(np.uint8), bitorder="little"))
        repeated[block["start"] + bits] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.view(np.int8), [0]])))
    return [(int(a), int(b) - 1 + window) for a, b in zip(edges[::2], edges[1::2])]


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for start, end in spans:
        kept += words[at : max(at, start)]
        at = max(at, end)
    return kept + words[at:]


def _finished(docs: DataFrame, listed: DataFrame, window: int, texts: bool) -> DataFrame:
    rows = in_batches(docs).select("doc_id", text_mark(), "text").join(listed.hint("shuffle_hash"), _same_text(), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, removed, out, found = [], [], [], []
            for text, blocks_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                spans = factors(len(words), blocks_, window)
                kept = without(words, spans)
                joined = b" ".join(kept)
                n_words.append(len(words))
                removed.append(len(words) - len(kept))
                out.append(joined.decode("utf-8") if texts else hashlib.sha256(joined).hexdigest())
                found.append([{"start": a, "length": b - a} for a, b in spans])
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            if texts:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))))
                names.append("factors")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"
    if texts:
        schema += ", factors array<struct<start: bigint, length: bigint>>"
    return rows.select("doc_id", "text", "listed").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each text without the words of windows that also start anywhere else.

    Columns doc_id, n_words, n_removed, kept (the words left, joined by one space) and factors
    (start, length in words). Windows are judged on the input.

    Null or empty text: no words. Texts shorter than a window: kept whole. Null doc_id: kept.
    Rows that repeat id and text repeat each other's windows. Empty input: no rows. Other
    columns are not looked at.
    """
    return _finished(docs, repeated_windows(docs, window, gram), window, True)


def digest_of_rest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the words kept in place of the words."""
    rest = _finished(docs, repeated_windows(docs, window, gram), window, False)
    return rest.withColumnRenamed("kept", "kept_sha256")
