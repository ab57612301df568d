"""Sharding by histogram sort: shards of near equal bytes that keep equal texts together.

Rows are ordered by (hash of the text, hash of the id, hash of the row number). Splitters of
that order are found by counting bytes in ever finer bins around each wanted place; only then
are rows dealt to their shards, once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import positions
from newsloom.session import materialize

LEVELS = ("k1", "k2", "k3")
BITS = 60
ROUND_BITS = 10


@dataclass(frozen=True)
class Place:
    """A splitter being refined: a bin of ``bits`` bits at a level, under fixed earlier keys."""

    fixed: tuple[int, ...] = ()
    bits: int = 0
    bin: int = 0
    base: int = 0  # bytes ahead of the bin


def order_keys() -> dict[str, Column]:
    """The keys of the order, each in [0, 2^60)."""
    unit = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    return {
        "k1": unit(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))),
        "k2": unit(F.xxhash64("doc_id", F.lit("id"))),
        "k3": unit(F.xxhash64(F.monotonically_increasing_id(), F.lit("row"))),
    }


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and one), text_crc32 and the keys of the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[key.alias(name) for name, key in order_keys().items()],
    )


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """Keys at which shards 1, 2, ... begin.

    Each round counts, for all open places at once, the bytes in 1,024 bins of the bin that
    holds the wanted place. A bin's edge is taken once it lies within ``tolerance`` (a part of
    a shard); a bin of one key is refined by the next key. The driver sees at most 1,024
    counts per open place.
    """
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    if not total:
        return [(2**BITS, 0, 0)] * (shards - 1)
    near = tolerance * total / shards
    wanted = {j: j * total / shards for j in range(1, shards)}
    open_places = {j: Place() for j in wanted}
    found: dict[int, tuple[int, int, int]] = {}
    while open_places:
        counted = {}
        for level in {len(p.fixed) for p in open_places.values()}:
            counted |= _count(rows, level, {p for p in open_places.values() if len(p.fixed) == level})
        refined: dict[int, Place] = {}
        for j, place in open_places.items():
            bits, run = min(place.bits + ROUND_BITS, BITS), place.base
            for bin_, size, low, high in counted[place]:
                if run + size >= wanted[j]:
                    break
                run += size
            edges = ((abs(wanted[j] - run), bin_), (abs(run + size - wanted[j]), bin_ + 1))
            last = low == high and len(place.fixed) == len(LEVELS) - 1
            if min(edges)[0] <= near or last:
                key = (*place.fixed, min(edges)[1] << (BITS - bits))
                found[j] = (*key, *[0] * (len(LEVELS) - len(key)))
            elif low == high:
                refined[j] = Place(fixed=(*place.fixed, low), base=run)
            else:
                refined[j] = replace(place, bits=bits, bin=bin_, base=run)
        open_places = refined
    return [found[j] for j in sorted(found)]


def _count(rows: DataFrame, level: int, places: set[Place]) -> dict[Place, list[tuple[int, int, int, int]]]:
    """Per place its finer bins in order: (bin, bytes, lowest key, highest key)."""
    key, out = F.col(LEVELS[level]), {}
    for group in {(p.fixed, p.bits) for p in places}:
        fixed, bits = group
        same = {p.bin: p for p in places if (p.fixed, p.bits) == group}
        finer = min(bits + ROUND_BITS, BITS)
        here = rows
        for name, value in zip(LEVELS, fixed):
            here = here.where(F.col(name) == value)
        if bits:
            here = here.where(F.shiftright(key, BITS - bits).isin(list(same)))
        bins = here.groupBy(F.shiftright(key, BITS - finer).alias("bin")).agg(
            F.sum("size").alias("b"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        for row in bins.orderBy("bin").collect():
            place = same[row["bin"] >> (finer - bits)]
            out.setdefault(place, []).append((row["bin"], row["b"], row["low"], row["high"]))
    return out


def shard_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or ahead of the row's key."""
    key = F.struct(*LEVELS)
    starts = [F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(LEVELS, s)]) for s in splitters]
    if not starts:
        return F.lit(0)
    return F.size(F.filter(F.array(*starts), lambda start: start <= key))


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, rows_per_block: int = 20_000) -> DataFrame:
    """Deal documents to ``shards`` shards of near equal bytes.

    Columns doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 in its shard, without
    gaps), grown_shard (null under this law). A group of equal texts is cut only where it is
    larger than the tolerance, a part of a shard's bytes.

    Null text: as the empty text (size 1, crc32 0). Null doc_id: hashed like any value.
    Repeated rows are rows of their own, told apart by row number. Empty input: no rows; fewer
    documents than shards: some shards stay empty. Other columns are not looked at.
    """
    rows = materialize(sized(docs), "shard-rows")
    splitters = find_splitters(rows, shards, tolerance)
    dealt = rows.withColumn("shard", shard_of(splitters))
    placed = positions(dealt, "shard", "k3", "slot", rows_per_block)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.005, files_per_shard: int = 1) -> None:
    """Write whole documents under ``path`` as shard=0, 1, ...; bodies move once.

    A column of ``docs`` named shard is replaced.
    """
    splitters = find_splitters(materialize(sized(docs), "shard-rows"), shards, tolerance)
    row = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("doc"), "doc_id", "text")
    out = row.withColumns(order_keys()).withColumn("shard", shard_of(splitters))
    dealt = out.repartition(shards * files_per_shard, "shard", F.pmod(F.col("k3"), F.lit(files_per_shard)))
    dealt.select("shard", "doc.*").write.partitionBy("shard").parquet(path)
