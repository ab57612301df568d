"""Exact deduplication against immutable snapshots.

The digests of a snapshot are spread over buckets; each bucket has a static binary fuse
filter, built in a task. Digests of a new batch, grouped among themselves first, are screened
by their bucket's filter. Only those it lets through are joined with the bucket, and their
texts compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import fuse
from newsloom.llm.common import SPACE, text_mark, without_rows
from newsloom.session import materialize

KEYS_PER_BUCKET = 200_000


def bare(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def digests(docs: DataFrame, *more) -> DataFrame:
    """doc_id, length in code points, SHA-256 of the bare text, mark, and columns ``more``."""
    return docs.select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("length"),
        F.unhex(F.sha2(bare(F.col("text")), 256)).alias("digest"),
        text_mark(),
        *more,
    )


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Per digest (and ``keys``): rows, and the best row.

    The order of ``best`` is most code points, then smallest id, a null id last.
    """
    best = F.max(_order())
    return rows.groupBy(*keys, "digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _order() -> Column:
    return F.struct("length", F.negate("doc_id").alias("minus_id"), "mark")


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


def _keys(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digest), dtype=">u8").astype(np.uint64)


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of the snapshot's distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, starts, table = fuse.build(_keys(pdf["digest"]))
        row = {"bucket": pdf["bucket"].iloc[0], "seed": seed, "length": length, "starts": starts, "table": table}
        return pd.DataFrame([row])

    keyed = snapshot.select(bucket(buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").applyInPandas(
        build, "bucket long, seed int, length long, starts long, table binary"
    )


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of ``batch`` (distinct) that their bucket's filter lets through."""

    def ask(incoming: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if incoming.empty or own.empty:
            return pd.DataFrame({"digest": pd.Series(dtype=object)})
        f = own.iloc[0]
        there = fuse.contains(_keys(incoming["digest"]), int(f["seed"]), int(f["length"]), int(f["starts"]), f["table"])
        return incoming.loc[there, ["digest"]]

    keyed = batch.select(bucket(buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, "digest binary")


def same_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (digest, ids of two documents), the digests whose documents have equal bare texts."""
    wanted = materialize(pairs.select("digest", F.explode("ids").alias("id")).distinct(), "exact-wanted")
    near = docs.select("doc_id", "text").join(
        wanted.select(F.col("id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
    )
    texts = near.select("doc_id", bare(F.col("text")).alias("bare"))
    texts = texts.select("doc_id", "bare", F.unhex(F.sha2("bare", 256)).alias("d"))
    met = wanted.join(texts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("d")))
    return met.groupBy("digest").agg(F.min("bare").alias("a"), F.max("bare").alias("b")).where("a = b").select("digest")


def merged_groups(rows: DataFrame, docs: DataFrame, batches: int, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """Groups of equal texts over all batches, from rows (doc_id, length, digest, batch).

    Batch 0 is the first snapshot; each further batch is screened by the filters of the
    snapshots ahead of it.
    """
    by_batch = materialize(grouped(rows, "batch"), "exact-batches")
    known = by_batch.where("batch = 0").drop("batch")
    for batch in range(1, batches):
        new = by_batch.where(F.col("batch") == batch).drop("batch")
        size = max(known.count(), new.count())  # a task gets a bucket of each
        buckets = max(1, -(-size // keys_per_bucket))
        passed = screen(new, build_filters(known, buckets), buckets)
        passed = materialize(passed, "exact-passed")
        old = known.select("digest", F.col("best").alias("old"))
        ids = F.array(F.negate("old.minus_id"), F.negate("best.minus_id")).alias("ids")
        met = new.join(passed, "digest", "left_semi").join(old, "digest").select("digest", ids)
        same = materialize(same_texts(met, docs), "exact-same")
        both = known.unionByName(new).join(same, "digest", "left_semi")
        both = both.groupBy("digest").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        alone = known.unionByName(new).join(same, "digest", "left_anti")
        known = materialize(alone.unionByName(both), "exact-known")
    return known


def halves(docs: DataFrame) -> Column:
    """Batch 0 for ids up to the middle of the id range, which stand for earlier arrivals, else 1."""
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends["a"] is None:
        return F.lit(0)
    return F.when(F.col("doc_id") > (ends["a"] + ends["b"]) // 2, 1).otherwise(0)


def _grouped_rows(docs: DataFrame, batch: Column | None, batches: int) -> tuple[DataFrame, DataFrame]:
    """The stored digests, and the groups of more than one row."""
    rows = materialize(digests(docs, (halves(docs) if batch is None else batch).alias("batch")), "exact-rows")
    return rows, materialize(merged_groups(rows, docs, batches).where("n > 1"), "exact-groups")


def drop_duplicates(docs: DataFrame, batch: Column | None = None, batches: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps."""
    rows, groups = _grouped_rows(docs, batch, batches)
    members = rows.join(groups, "digest").select(
        F.col("doc_id").alias("id"), "mark", _order().eqNullSafe(F.col("best")).alias("is_best")
    )
    members = materialize(members, "exact-members")
    doubled = members.where("is_best").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    dropped = members.where("not is_best").select("id", "mark").distinct()
    return without_rows(docs, materialize(dropped, "exact-dropped"), materialize(doubled, "exact-doubled"))


def exact_duplicates(docs: DataFrame, batch: Column | None = None, batches: int = 2) -> DataFrame:
    """For each row the row that stays of its group of equal texts, white space aside.

    ``batch`` numbers the arrivals from 0; by default the earlier and the later half of the
    ids. The result does not depend on it. Columns doc_id, keep_id, group_size, kept,
    text_sha256. The row with the most code points stays, then the smallest id.

    Null text: empty; all empty texts are one group. Null doc_id: last choice, and kept as
    null. Rows equal in text, length and id: one of them has kept = true. Empty input: no
    rows. Other columns are not looked at.
    """
    rows, groups = _grouped_rows(docs, batch, batches)
    single = rows.groupBy("digest", "doc_id", "length", "mark").agg(F.count(F.lit(1)).alias("times"))
    owned = single.join(groups, "digest", "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.negate("best.minus_id"))
    best = _order().eqNullSafe(F.col("best")) | F.col("n").isNull()
    each = owned.select(
        "*", keep_id.alias("keep_id"), best.alias("is_best"), F.posexplode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    )
    return each.select(
        "doc_id",
        "keep_id",
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("is_best") & (F.col("pos") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
