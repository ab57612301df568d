"""Topic expressions: story signal, football check, league labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.config import (
    FOOTBALL_DOMAIN,
    FOOTBALL_TERMS,
    LEAGUE_KEYS,
    TOPICS,
    TREND_TERMS,
    TRANSFER_TERMS,
)
from newsloom.functions.binding import let


def _minimal(terms: tuple[str, ...]) -> list[str]:
    """Terms that hold no other term; matching these is the same as matching all."""
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def mentions_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Substring test against a word list; each probe is a plain byte search."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in _minimal(terms)])


def haystack(*parts: Column) -> Column:
    """Lower-cased parts joined by single spaces; a missing part counts as ''."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def signal_of(text: Column) -> Column:
    return (
        F.when(mentions_any(text, TRANSFER_TERMS), "transfers")
        .when(mentions_any(text, TREND_TERMS), "trends")
        .otherwise("general_news")
    )


def classify_signal(title: Column, excerpt: Column, keywords: Column, existing: Column | None = None) -> Column:
    """Story class from title, excerpt and keyword list; a non-empty existing class wins."""
    fresh = let(haystack(title, excerpt, F.concat_ws(" ", keywords)), signal_of)
    return fresh if existing is None else F.coalesce(F.nullif(existing, F.lit("")), fresh)


_OVERLAP = max(len(t) for t in TRANSFER_TERMS + TREND_TERMS) - 1


def signal_parts(title: Column, content: Column, bucket: Column) -> Column:
    """What ``classify_signal`` needs of a text whose last keyword is not known yet.

    The class without that keyword, and the end of the text, into which a term could run.
    """
    parts = lambda t: F.struct(signal_of(t).alias("kind"), F.right(t, F.lit(_OVERLAP)).alias("end"))
    return let(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")), bucket)), parts)


def signal_with(parts: Column, keyword: Column) -> Column:
    """``classify_signal`` with the keywords (bucket, ``keyword``), from its parts."""
    end = F.concat_ws(" ", parts["end"], F.lower(keyword))
    return (
        F.when((parts["kind"] == "transfers") | mentions_any(end, TRANSFER_TERMS), "transfers")
        .when((parts["kind"] == "trends") | mentions_any(end, TREND_TERMS), "trends")
        .otherwise("general_news")
    )


def is_topic_article(
    league: Column, bucket: Column, title: Column, excerpt: Column,
    content: Column, publisher_name: Column, keywords: Column,
) -> Column:
    """Football article: by its league/bucket key, else by any football term in its text."""
    key = F.coalesce(F.nullif(league, F.lit("")), F.nullif(bucket, F.lit("")), F.lit(""))
    text = haystack(title, excerpt, content, publisher_name, F.concat_ws(" ", keywords))
    return key.isin(*LEAGUE_KEYS) | let(text, lambda t: mentions_any(t, FOOTBALL_TERMS))


def league_label(league: Column) -> Column:
    label = F.lit(None).cast("string")
    for key, domain, text, _, _ in TOPICS:
        if domain == FOOTBALL_DOMAIN:
            label = F.when(league == key, F.lit(text)).otherwise(label)
    return label
