"""Admission of discovered items under deduplication, domain caps and bucket quotas.

Items carry ``bucket``, ``page``, ``bucket_pos``, ``pos`` and ``url``. Decisions are made on
those keys only; titles and excerpts are joined back for the rows that were admitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import DOMAIN_CAP_RATIO, INIT_QUOTA
from newsloom.functions.urls import normalize_url, url_domain
from newsloom.operators.filters import admissible_url
from newsloom.operators.joins import anti_join_seen, hint_small
from newsloom.operators.ranking import first_k, first_per_key

ITEM_KEY = ("bucket", "page", "pos")
PAGE_BLOCK = 64


def domain_cap(quota: int) -> int:
    return int(DOMAIN_CAP_RATIO * max(1, quota))


def candidate_keys(items: DataFrame) -> DataFrame:
    """The narrow columns that decide admission."""
    keyed = items.select(
        "bucket", "bucket_pos", F.col("page").cast("bigint").alias("page"), "pos",
        normalize_url(F.col("url")).alias("url_norm"),
    )
    return keyed.withColumn("domain", url_domain(F.col("url_norm")))


def visit_order() -> list[Column]:
    """Round-robin: page by page, buckets in turn, items in page order."""
    return [F.col("page").asc(), F.col("bucket_pos").asc(), F.col("pos").asc()]


def _page_block() -> Column:
    return F.floor(F.col("page") / PAGE_BLOCK)


def first_seen_dedup(keys: DataFrame) -> DataFrame:
    return first_per_key(keys, ["url_norm"], visit_order())


def cap_domains(keys: DataFrame, cap: int) -> DataFrame:
    return first_k(keys, ["bucket", "domain"], visit_order(), F.lit(cap), cap, _page_block())


def cap_buckets(keys: DataFrame, quota: int) -> DataFrame:
    return first_k(keys, ["bucket"], visit_order(), F.lit(quota), quota, _page_block())


def admit_keys(items: DataFrame, seen: DataFrame, quota: int = INIT_QUOTA, cap: int | None = None) -> DataFrame:
    """Keys of the admitted items with one fixed quota per bucket.

    First-seen comes before the anti-join: both need the same partitioning by
    ``url_norm``, and the group limit has then already removed hot URLs.
    """
    fresh = anti_join_seen(first_seen_dedup(admissible_url(candidate_keys(items))), seen)
    capped = cap_domains(fresh, domain_cap(quota) if cap is None else cap)
    return cap_buckets(capped, quota)


def admit_static(
    items: DataFrame, seen: DataFrame, quota: int = INIT_QUOTA, cap: int | None = None, buckets: int = 1000
) -> DataFrame:
    """Admitted items. ``buckets`` bounds the number of buckets, so the result has at
    most ``quota * buckets`` rows."""
    admitted = admit_keys(items, seen, quota, cap).select(*ITEM_KEY)
    return items.join(hint_small(admitted, quota * buckets), list(ITEM_KEY), "left_semi")


def decided_items(items: DataFrame, admitted: DataFrame, quota: int) -> DataFrame:
    """Items the visit looks at, each with its decision.

    A bucket whose quota filled up stops at the item that filled it; what lies behind it
    is never looked at. The cut is one row per bucket.
    """
    cut = (
        admitted.groupBy("bucket")
        .agg(F.count("*").alias("_n"), F.max(F.struct("page", "pos")).alias("_last"))
        .where(F.col("_n") >= quota)
        .select("bucket", "_last")
    )
    marked = items.select(*ITEM_KEY).join(
        admitted.select(*ITEM_KEY, F.lit(True).alias("_hit")), list(ITEM_KEY), "left"
    )
    looked_at = marked.join(cut, "bucket", "left").where(
        F.col("_last").isNull() | (F.struct("page", "pos") <= F.col("_last"))
    )
    return looked_at.select(*ITEM_KEY, F.coalesce("_hit", F.lit(False)).alias("accepted"))
