"""Text expressions: whitespace, hashing, snippets, content choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.config import SNIPPET_CHARS
from newsloom.functions.binding import let

# Every code point Unicode counts as white space (fixed values), as a regex for SQL
# counterparts and as a plain string for trimming and translating.
WHITESPACE = (
    r"[\s\x0B\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
WHITESPACE_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def non_blank(text: Column) -> Column:
    """Stripped text, with blank counted as missing."""
    return F.nullif(strip(text), F.lit(""))


_OTHER_SPACES = WHITESPACE_CHARS.replace(" ", "")


def normalize_text(text: Column) -> Column:
    """Collapse white space to single spaces and trim; null gives ''.

    Mapping every white space to a plain one first leaves the regex only runs of two or
    more to find, which is twice as fast as matching the whole class.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _OTHER_SPACES, " " * len(_OTHER_SPACES))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def content_id(text: Column) -> Column:
    """SHA-1 (hex) of the normalized text."""
    return F.sha1(normalize_text(text))


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def embedding_text(title: Column, content: Column) -> Column:
    """``title. content``, or whichever of the two is not blank ('' if neither)."""
    return F.concat_ws(". ", non_blank(title), non_blank(content))


def choose_content(paywall: Column, extracted: Column, excerpt: Column) -> Column:
    """Paywalled items keep the excerpt; others fall back to it when extraction is empty."""
    fallback = F.coalesce(excerpt, F.lit(""))
    found = let(extracted, lambda t: F.when(t == "", fallback).otherwise(F.coalesce(t, fallback)))
    return F.when(F.coalesce(paywall, F.lit(False)), fallback).otherwise(found)


def drop_null_items(values: Column) -> Column:
    """A list without null items; a null list becomes an empty one."""
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(values, empty), lambda v: v.isNotNull())


def string_list(value: Column) -> Column:
    """List of strings from a VARIANT: list, single value or null/absent."""
    as_list = F.try_variant_get(value, "$", "array<string>")
    single = F.try_variant_get(value, "$", "string")
    return F.when(
        F.schema_of_variant(value).startswith("ARRAY"), drop_null_items(as_list)
    ).otherwise(drop_null_items(F.array(single)))


_INTEGER = r"^[+-]?[0-9]+$"


def safe_int(text: Column) -> Column:
    """Integer text to int; anything else, or out of range, to null."""
    digits = strip(text)
    return F.when(digits.rlike(_INTEGER), digits.try_cast("int"))
