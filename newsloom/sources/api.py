"""JSON result pages of a news search API to item rows and page metadata.

Input: one row per fetched page with ``page`` and ``body`` (plus columns to carry).
The body is read as VARIANT because the rules tell an absent key from a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.config import ITEMS_PER_PAGE
from newsloom.functions.dates import date_status, parse_iso
from newsloom.functions.text import non_blank, safe_int, string_list


def _text(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")


def _present(value: Column, key: str) -> Column:
    return F.variant_get(value, f"$.{key}", "variant").isNotNull()


def _is_null_literal(value: Column, key: str) -> Column:
    return F.is_variant_null(F.variant_get(value, f"$.{key}", "variant"))


def _is_text(value: Column, key: str) -> Column:
    return F.schema_of_variant(F.variant_get(value, f"$.{key}", "variant")) == "STRING"


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _default_if_absent(value: Column, key: str, default: str) -> Column:
    return F.when(_present(value, key), _text(value, key)).otherwise(default)


def _counts(value: Column, key: str) -> Column:
    """Present and neither null, empty text nor the number zero."""
    zero = ~_is_text(value, key) & (F.try_variant_get(value, f"$.{key}", "double") == 0)
    return F.coalesce((_text(value, key) != "") & ~F.coalesce(zero, F.lit(False)), F.lit(False))


def _integer(value: Column, key: str) -> Column:
    """Integer text or a JSON number (its whole part); anything else is null."""
    number = F.try_variant_get(value, f"$.{key}", "int")
    return F.when(_is_text(value, key), safe_int(_text(value, key))).otherwise(number)


def _items(pages: DataFrame) -> DataFrame:
    carried = [c for c in pages.columns if c != "body"]
    listed = F.try_variant_get(F.try_parse_json(F.col("body")), "$.data", "array<variant>")
    return pages.select(*carried, F.posexplode(listed).alias("pos", "_item"))


def _well_formed(item: Column) -> Column:
    """The row-level contract: a text url, and a publisher that is an object or absent."""
    publisher = F.variant_get(item, "$.publisher", "variant")
    return (
        _is_object(item)
        & F.coalesce(_is_text(item, "url"), F.lit(False))
        & (publisher.isNull() | F.coalesce(_is_object(publisher), F.lit(False)))
        & ~F.coalesce(_is_null_literal(item, "publisher"), F.lit(False))
    )


def api_items(pages: DataFrame) -> DataFrame:
    """Item rows of all pages in page order; malformed items are left out."""
    rows = _items(pages).where(_well_formed(F.col("_item")))
    item = F.col("_item")
    date_text = _text(item, "date")
    published = parse_iso(date_text)
    return rows.select(
        *[c for c in pages.columns if c != "body"],
        "pos",
        _text(item, "url").alias("url"),
        _default_if_absent(item, "title", "No title").alias("title"),
        _default_if_absent(item, "excerpt", "").alias("excerpt"),
        F.coalesce(F.try_variant_get(item, "$.paywall", "boolean"), F.lit(False)).alias("paywall"),
        string_list(F.variant_get(item, "$.authors", "variant")).alias("authors"),
        string_list(F.variant_get(item, "$.keywords", "variant")).alias("keywords"),
        F.try_variant_get(item, "$.publisher.name", "string").alias("publisher_name"),
        published.alias("published_date"),
        date_status(non_blank(date_text), published).alias("date_status"),
        _text(item, "thumbnail").alias("thumbnail"),
        F.when(_counts(item, "contentLength"), _integer(item, "contentLength"))
        .otherwise(_integer(item, "content_length"))
        .alias("content_length"),
        F.lit(None).cast("string").alias("league"),
        F.lit(None).cast("string").alias("signal_type"),
        F.lit("api").alias("source_type"),
        F.lit(None).cast("string").alias("source_feed"),
    )


def malformed_api_items(pages: DataFrame) -> DataFrame:
    """The items ``api_items`` leaves out, as JSON text."""
    rows = _items(pages).where(~F.coalesce(_well_formed(F.col("_item")), F.lit(False)))
    return rows.select(
        *[c for c in pages.columns if c != "body"], "pos", F.to_json(F.col("_item")).alias("item")
    )


def api_page_meta(pages: DataFrame) -> DataFrame:
    """Paging numbers of every page; the page count is derived when the API omits it."""
    body = F.try_parse_json(F.col("body"))

    def number(key: str) -> Column:
        return F.try_variant_get(body, f"$.{key}", "bigint")

    hits = F.coalesce(number("totalHits"), F.lit(0).cast("bigint"))
    size = F.coalesce(number("size"), F.lit(ITEMS_PER_PAGE).cast("bigint"))
    given = F.coalesce(number("totalPages"), F.lit(0).cast("bigint"))
    derived = F.when((given == 0) & (hits > 0) & (size > 0), F.ceil(hits / F.nullif(size, F.lit(0)))).otherwise(given)
    return pages.select(
        *[c for c in pages.columns if c != "body"],
        hits.alias("total_hits"), derived.cast("bigint").alias("total_pages"), size.alias("page_size"),
    )
