"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Of two fingerprints that differ in at most ``distance``
bits, some segment differs in at most ``distance // segments``; each fingerprint therefore
enters the table of a segment under every value in that small Hamming ball, and whoever meets
under one value has its complete distance checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_batches, text_mark, without_rows
from newsloom.llm.components import connected
from newsloom.session import materialize

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
LARGEST_MEETING = 20_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the XXH64 (seed 42) of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[words - 1 :].tolist() if len(parts) >= words else [len(joined)]
    first = [0, *(ends[: len(parts) - words] + 1).tolist()] if len(parts) >= words else [0]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        chunk = hashes[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp) with the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t, words) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            columns = [batch.column(0), batch.column(1), pa.array(made.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", text_mark(), "text").mapInArrow(run, f"doc_id {kind}, mark binary, fp bigint")


def layout(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of 64 bits."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of up to ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def table_entries(prints: DataFrame, segments: int, distance: int) -> DataFrame:
    """(segment, value, fp) for every value a fingerprint is entered under.

    Of two segment values a ball apart, both meet under the value with the differing bits
    cleared, so only balls that clear bits are entered.
    """
    masks = [(s, first, bits, ball(bits, distance // segments)) for s, (first, bits) in enumerate(layout(segments))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s, first, bits, ball_masks in masks:
                own = (fp >> np.uint64(first)) & np.uint64(2**bits - 1)
                who, mask = np.nonzero((own[:, None] & ball_masks) == ball_masks)
                value = (own[who] & ~ball_masks[mask]) | np.uint64(s << 56)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(fp[who].view(np.int64))], ["value", "fp"]
                )

    return prints.mapInArrow(run, "value bigint, fp bigint")


def crowded_values(prints: DataFrame, segments: int, distance: int, most: int) -> DataFrame:
    """(value, blocks) for all values under which over ``2 * most`` fingerprints meet.

    Fingerprints are counted by their own segment values. A crowded value has a contributor
    of over ``most`` by the number of values that are entered under it, so only those counts
    are carried to the values of their balls.
    """
    masks = [(s, first, bits, ball(bits, distance // segments)) for s, (first, bits) in enumerate(layout(segments))]
    counts = None
    for s, first, bits, _ in masks:
        value = F.shiftright("fp", first).bitwiseAND(2**bits - 1).bitwiseOR(s << 56)
        own = prints.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        own = own.where(F.col("n") > max(1, most // len(masks[s][3])))
        counts = own if counts is None else counts.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s, _, _, ball_masks in masks:
                here = (value >> 56) == s
                own = value[here].view(np.uint64)
                who, mask = np.nonzero((own[:, None] & ball_masks) == ball_masks)
                cleared = own[who] & ~ball_masks[mask]
                yield pa.RecordBatch.from_arrays([pa.array(cleared.view(np.int64)), pa.array(n[here][who])], ["value", "n"])

    met = counts.mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    return met.where(F.col("n") > most).select("value", F.ceil(F.col("n") / most).cast("int").alias("blocks"))


def stars(fp: np.ndarray, distance: int) -> np.ndarray:
    """Links (a, b) that connect what is connected by pairs of at most ``distance`` bits.

    From the smallest fingerprint on, each one reached is compared with those not yet reached
    only; a dense group costs little more than its size, and gives one link per member.
    """
    left = np.unique(fp.view(np.uint64))
    links = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= distance
            if near.any():
                reached = left[near]
                links.append(np.stack([np.full(len(reached), root), reached], axis=1))
                todo.extend(reached)
                left = left[~near]
    return np.concatenate(links).view(np.int64) if links else np.zeros((0, 2), np.int64)


def fingerprint_links(
    prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = LARGEST_MEETING
) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the components of all close pairs.

    A value under which many meet is split: its fingerprints are dealt to blocks, and every
    pair of blocks meets in a task of its own.
    """
    entries = table_entries(prints, segments, distance)
    crowded = materialize(crowded_values(prints, segments, distance, most), "simhash-crowded")
    split = entries.join(crowded, "value", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    pairs = split.select("value", "fp", F.coalesce(mine, F.lit(0)).cast("int").alias("mine"), other.alias("other"))
    met = pairs.select("value", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "fp")
    met = met.repartition("value", "x", "y").sortWithinPartitions("value", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 4), np.int64)  # the last group so far: it may go on in the next batch
        for batch in batches:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([kept, now])
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            kept = rows[starts[-1] :]
            yield from _linked(rows[: starts[-1]], starts, distance)
        yield from _linked(kept, np.array([0, len(kept)]), distance)

    return met.mapInArrow(run, "a bigint, b bigint")


def _linked(rows: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(starts)
    found = [stars(rows[s : s + n, 3].copy(), distance) for s, n in zip(starts[:-1][sizes > 1], sizes[sizes > 1])]
    found = [x for x in found if len(x)]
    if found:
        links = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = LARGEST_MEETING
) -> DataFrame:
    """Fingerprint and component of each document.

    Columns doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable
    over links of at most ``distance`` differing bits.

    Null or empty text: fingerprint zero, linked like any other. Texts of fewer words than a
    shingle: one shingle of all words. Null doc_id: its row is placed by its fingerprint, and
    counts as a component's id only if all others are null too. Repeated rows stay. Empty
    input: no rows. Other columns are not looked at.
    """
    rows = materialize(fingerprints(docs, words), "simhash-rows")
    return _answer(rows, components(rows, distance, segments, most))


def components(rows: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = LARGEST_MEETING) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of stored rows of ``fingerprints``."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-prints")
    roots = connected(fingerprint_links(prints.select("fp"), distance, segments, most), "simhash-links")
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialize(placed.join(lowest, "root").select("fp", "root", "component_id"), "simhash-components")


def _answer(rows: DataFrame, found: DataFrame) -> DataFrame:
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = LARGEST_MEETING
) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component: the smallest doc_id stays."""
    rows = materialize(fingerprints(docs, words), "simhash-rows")
    found = components(rows, distance, segments, most)
    # a null id comes after all others
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    placed = materialize(rows.join(found, "fp").select("root", "doc_id", "mark", order.alias("at")), "simhash-placed")
    first = placed.groupBy("root").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = placed.join(first, "root").select(F.col("doc_id").alias("id"), "mark", (F.col("at") == F.col("first")).alias("stays"))
    members = materialize(members, "simhash-members")
    doubled = members.where("stays").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    dropped = members.where("not stays").select("id", "mark").distinct()
    return without_rows(docs, materialize(dropped, "simhash-dropped"), materialize(doubled, "simhash-doubled"))
