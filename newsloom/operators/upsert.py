"""Upsert of an ordered batch into tables with one or two unique keys.

The corpus has two keys. Replayed row by row the rule is: a row whose content already
belongs to another URL is rejected; otherwise the row replaces whatever its URL held, and
the URL's previous content becomes free. ``seq`` gives the replay order.

Almost every row can be decided from aggregates. If no URL that offers a content ever
offers another one, the content's owner never lets go, so the first URL to offer it wins
for good, however many copies there are. Only contents offered by several URLs, one of
which also offers another content, depend on the replay order. For those, acceptance of
a row is a function of the accepted rows before it, so it is computed in rounds from a
guess until nothing changes; each round settles at least the earliest open row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import normalize_url
from newsloom.operators.ranking import nearest_in_key
from newsloom.session import materialize

BEFORE_BATCH = -1
SEQ_BLOCK = 1 << 20

CORPUS_PAYLOAD = (
    "publisher_name", "date", "title", "content", "bucket", "league", "signal_type",
    "source_type", "source_feed",
)


def _content_key() -> Column:
    """A missing content id never collides: it stands for itself under its URL."""
    return F.coalesce("content_id", F.concat(F.lit(":"), "url"))


def _touched(existing: DataFrame, offers: DataFrame) -> DataFrame:
    """Existing (url, content) pairs that share a key with the batch. Narrow columns only."""
    held = existing.select("url", _content_key().alias("ck"))
    by_url = held.join(offers.select("url"), "url", "left_semi")
    by_content = held.join(offers.select("ck"), "ck", "left_semi").select("url", "ck")
    return by_url.unionByName(by_content).distinct()


def _more_than_one(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(key)


def _replay(events: DataFrame, block: int) -> DataFrame:
    """Fixed point of the acceptance rule over the given rows; adds ``accepted``."""
    seq_block = F.floor(F.col("seq") / block) if events.count() > block else None
    # Guess: a content stays with the first URL that offers it.
    first = events.groupBy("ck").agg(F.min_by("url", "seq").alias("_first"))
    current = materialize(
        events.join(first, "ck").select("seq", "url", "ck", (F.col("url") == F.col("_first")).alias("accepted")),
        "replay",
    )
    while True:
        # When does the URL of an accepted row next hold something (else)?
        moved = nearest_in_key(
            current, "url", "seq", F.when(F.col("accepted"), F.col("seq")),
            before=False, block=seq_block, name="_next",
        )
        owner = F.when(F.col("accepted"), F.struct("url", F.col("_next").alias("left_at")))
        judged = nearest_in_key(moved, "ck", "seq", owner, before=True, block=seq_block, name="_owner")
        free = (
            F.col("_owner").isNull()
            | (F.col("_owner.url") == F.col("url"))
            | F.coalesce(F.col("_owner.left_at") < F.col("seq"), F.lit(False))
        )
        settled = materialize(
            judged.select("seq", "url", "ck", "accepted", (free | (F.col("seq") == BEFORE_BATCH)).alias("_now")),
            "replay",
        )
        current = settled.select("seq", "url", "ck", F.col("_now").alias("accepted"))
        if settled.where(F.col("accepted") != F.col("_now")).isEmpty():
            return current


def winning_rows(existing: DataFrame, batch: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """(url, seq): for every URL the batch changes, the batch row it ends up with."""
    rows = batch.select(F.col("seq").cast("bigint").alias("seq"), "url", _content_key().alias("ck"))
    offers = rows.groupBy("url", "ck").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    offers = materialize(offers, "offers")
    held = materialize(_touched(existing, offers), "held")
    pairs = (
        offers.unionByName(
            held.withColumn("first", F.lit(BEFORE_BATCH).cast("bigint")).withColumn("last", F.col("first"))
        )
        .groupBy("url", "ck")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    pairs = materialize(pairs, "pairs")

    movers = _more_than_one(pairs, "url")
    contested = _more_than_one(pairs, "ck")
    ordered = materialize(
        pairs.join(movers, "url", "left_semi").join(contested, "ck", "left_semi").select("ck").distinct(),
        "order-dependent",
    )
    if ordered.isEmpty():
        return _owners_last(pairs)

    # All rows of the URLs around order-dependent contents, with what they held before.
    urls = materialize(pairs.join(ordered, "ck", "left_semi").select("url").distinct(), "replay-urls")
    events = rows.join(urls, "url", "left_semi").unionByName(
        held.join(urls, "url", "left_semi").select(F.lit(BEFORE_BATCH).cast("bigint").alias("seq"), "url", "ck")
    )
    replayed = _replay(materialize(events, "events"), block)
    last = (
        replayed.where("accepted").groupBy("url").agg(F.max("seq").alias("seq")).where(F.col("seq") > BEFORE_BATCH)
    )
    return _owners_last(pairs.join(urls, "url", "left_anti")).unionByName(last)


def _owners_last(pairs: DataFrame) -> DataFrame:
    """First URL per content, then the last such content per URL."""
    owners = pairs.groupBy("ck").agg(F.min(F.struct("first", "url", "last")).alias("o"))
    return (
        owners.select("o.url", "o.last")
        .groupBy("url")
        .agg(F.max("last").alias("seq"))
        .where(F.col("seq") > BEFORE_BATCH)
    )


def corpus_changes(
    existing: DataFrame, batch: DataFrame, batch_ts: Column | None = None, block: int = SEQ_BLOCK
) -> DataFrame:
    """Corpus rows the batch writes, one per changed URL.

    ``inserted_at`` is kept for a URL that exists already. ``is_update`` tells it apart. Both
    are settled on narrow columns and written; the texts move once, to the rows so chosen.
    """
    stamp = F.current_timestamp() if batch_ts is None else batch_ts
    winners = winning_rows(existing, batch, block)
    payload = batch.withColumn("seq", F.col("seq").cast("bigint"))
    chosen = payload.select("seq", "url").join(winners.select("seq"), "seq", "left_semi").distinct()
    held = existing.join(winners.select("url"), "url", "left_semi").select(
        "url", F.col("inserted_at").alias("_held_at"), F.lit(True).alias("_held")
    )
    settled = materialize(
        chosen.join(held, "url", "left").select(
            F.col("seq").alias("_seq"), F.col("url").alias("_url"),
            F.coalesce("_held_at", stamp).alias("inserted_at"), F.coalesce("_held", F.lit(False)).alias("is_update"),
        ),
        "settled",
    )
    same = (F.col("seq") == F.col("_seq")) & F.col("url").eqNullSafe(F.col("_url"))
    return payload.join(settled, same).select(
        "url", "content_id", *CORPUS_PAYLOAD, normalize_url(F.col("url")).alias("url_norm"), "inserted_at", "is_update"
    )


def upsert_corpus(
    existing: DataFrame, batch: DataFrame, batch_ts: Column | None = None, block: int = SEQ_BLOCK
) -> DataFrame:
    """The whole corpus after the batch."""
    changes = materialize(corpus_changes(existing, batch, batch_ts, block), "changes").drop("is_update")
    untouched = existing.select(changes.columns).join(changes.select("url"), "url", "left_anti")
    return untouched.unionByName(changes)


def last_vector_per_id(batch: DataFrame) -> DataFrame:
    """One row per content id: url and title of its first row, embedding of its last."""
    return batch.groupBy("content_id").agg(
        F.min_by(F.struct("url", "title"), "seq").alias("_who"),
        F.max_by(F.struct("embedding", "embedded_at"), "seq").alias("_what"),
    ).select("content_id", "_who.url", "_who.title", "_what.embedding", "_what.embedded_at")


def upsert_vectors(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Vectors after the batch: a known id changes only embedding and time.

    A small batch is broadcast by size, so the existing vectors need not move.
    """
    fresh = last_vector_per_id(batch)
    replaced = fresh.select(
        "content_id", F.col("embedding").alias("_e"), F.col("embedded_at").alias("_t"), F.lit(True).alias("_hit")
    )
    hit = F.coalesce("_hit", F.lit(False))
    kept = existing.join(replaced, "content_id", "left").select(
        "content_id", "url", "title",
        F.when(hit, F.col("_e")).otherwise(F.col("embedding")).alias("embedding"),
        F.when(hit, F.col("_t")).otherwise(F.col("embedded_at")).alias("embedded_at"),
    )
    known = existing.select("content_id").join(fresh.select("content_id"), "content_id", "left_semi")
    return kept.unionByName(fresh.join(known, "content_id", "left_anti").select(kept.columns))
