"""URL expressions: normalization for comparison, and host extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.config import TRACKING_PARAMS
from newsloom.functions.binding import let
from newsloom.functions.text import strip

_HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_PARTS = r"^([^:]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_NETLOC = r"^[^:/?#]+://([^/?#]*)"
_STRAY_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def _form_decode(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, _STRAY_PERCENT, "%25"))


def _form_encode(text: Column) -> Column:
    # The JVM encoder keeps '*' and escapes '~'; the form wanted here is the reverse.
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _clean_query(query: Column) -> Column:
    """Drop tracking keys, then sort and re-encode what is left."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _form_decode(F.regexp_replace(p, "^[^=]*=", "")))
            .otherwise("")
            .alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda kv: ~kv["k"].isin(*TRACKING_PARAMS)))
    return F.array_join(
        F.transform(kept, lambda kv: F.concat(_form_encode(kv["k"]), F.lit("="), _form_encode(kv["v"]))),
        "&",
    )


def _assemble(full: Column) -> Column:
    scheme = F.lower(F.regexp_extract(full, _PARTS, 1))
    netloc = F.lower(F.regexp_extract(full, _PARTS, 2))
    netloc = (
        F.when(scheme == "http", F.regexp_replace(netloc, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(netloc, ":443$", ""))
        .otherwise(netloc)
    )
    # An empty parameter part on the last path segment disappears; an empty path is '/'.
    path = F.regexp_replace(F.regexp_extract(full, _PARTS, 3), r"(/[^/;]*);$", "$1")
    path = F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))
    query = let(
        F.regexp_extract(full, _PARTS, 4),
        lambda raw: F.when(raw == "", raw).otherwise(let(_clean_query(raw), _with_mark)),
    )
    return F.concat(scheme, F.lit("://"), netloc, path, query)


def _with_mark(query: Column) -> Column:
    return F.when(query == "", query).otherwise(F.concat(F.lit("?"), query))


def normalize_url(url: Column) -> Column:
    """Canonical form of a URL for duplicate detection; null or empty gives ''."""
    full = F.when(url.rlike(_HAS_SCHEME), url).otherwise(F.concat(F.lit("https://"), url))
    whole = let(F.regexp_replace(full, r"[\t\r\n]", ""), _assemble)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(whole)


def url_domain(url: Column) -> Column:
    """Lower-cased network location, port and user info included; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _NETLOC, 1))


def raw_domain(given: Column, url: Column) -> Column:
    """The supplied publisher domain, or the URL's own network location."""
    return F.coalesce(F.nullif(given, F.lit("")), F.regexp_extract(url, _NETLOC, 1))


def publisher_domain(given: Column, url: Column) -> Column:
    return F.regexp_replace(F.lower(strip(raw_domain(given, url))), r"^www\.", "")
