"""Text of an HTML page: all that is visible, or its main text alone.

``main_text`` cuts the page into blocks at its block elements and judges each block by its
words, the share of them inside links, and the same of its neighbours, by the decision tree of
Kohlschütter, Fankhauser and Nejdl (Boilerplate Detection using Shallow Text Features, 2010).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import normalize_text

# Elements dropped with their content (fixed values).
DROPPED_ELEMENTS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
# Entities decoded, '&amp;' last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))

DROPPED_PATTERN = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in DROPPED_ELEMENTS)
COMMENT_PATTERN = r"(?s)<!--.*?-->"
HEAD_PATTERN = r"(?is)<head\b[^>]*>.*?</head\s*>"
TAG_PATTERN = r"(?s)<[^>]+>"
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"


def _decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_text(html: Column) -> Column:
    text = html
    for pattern in (DROPPED_PATTERN, COMMENT_PATTERN, HEAD_PATTERN, TAG_PATTERN):
        text = F.regexp_replace(text, pattern, " ")
    return normalize_text(_decode(text))


# Elements that end a block of text (fixed values).
BLOCK_ELEMENTS = (
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "iframe", "li", "main", "menu",
    "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
# Marks put in place of tags: link from, link to, block border, container from, container to.
LINK, LINK_END, BORDER, INSIDE, INSIDE_END = "\x01", "\x02", "\x03", "\x04", "\x05"
# (pattern, what stands for its matches), in this order.
MARKINGS = (
    (r"[\x01-\x05]", " "),
    (DROPPED_PATTERN, BORDER),
    (COMMENT_PATTERN, " "),
    (HEAD_PATTERN, BORDER),
    (r"(?is)<(?:article|main)\b[^>]*>", BORDER + INSIDE),
    (r"(?is)</(?:article|main)\s*>", INSIDE_END + BORDER),
    (r"(?is)<a\b[^>]*>", LINK),
    (r"(?is)</a\s*>", LINK_END),
    (rf"(?is)</?(?:{'|'.join(BLOCK_ELEMENTS)})\b[^>]*>", BORDER),
    (TAG_PATTERN, " "),
)
CONTAINER_PATTERN = r"(?s)\x04(.*)\x05"  # from the first container's start to the last one's end
CONTAINER_CHARS = 200
LINKED_PATTERN = r"(?:^|\x01)[^\x01\x02]*\x02|\x01[^\x01\x02]*$"
MARKS_PATTERN = r"[\x01\x02\x04\x05]"


def _marked(html: Column) -> Column:
    for pattern, mark in MARKINGS:
        html = F.regexp_replace(html, pattern, mark)
    return _decode(html)


def _words(text: Column) -> Column:
    """Number of words of a normalized text."""
    return F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def _block(piece: Column) -> Column:
    plain = normalize_text(F.regexp_replace(piece, MARKS_PATTERN, " "))
    linked = F.array_join(F.regexp_extract_all(piece, F.lit(LINKED_PATTERN), F.lit(0)), " ")
    linked = normalize_text(F.regexp_replace(linked, MARKS_PATTERN, " "))
    return let(plain, lambda t: F.struct(t.alias("text"), _words(t).alias("words"), _words(linked).alias("links")))


def text_blocks(html: Column) -> Column:
    """array<struct<text, words, links>>: the page's non-empty blocks, in order, and their words in links.

    Where the page marks its article or main part, and that is more than a stub, the blocks of
    that part only. A null page has none.
    """

    def pieces(marked: Column) -> Column:
        inside = F.regexp_extract(marked, CONTAINER_PATTERN, 1)
        return let(inside, lambda part: F.split(F.when(F.char_length(part) >= CONTAINER_CHARS, part).otherwise(marked), BORDER))

    found = F.transform(let(_marked(F.coalesce(html, F.lit(""))), pieces), _block)
    return F.filter(found, lambda b: b["words"] > 0)


def is_main(block: Column, before: Column, after: Column) -> Column:
    """Whether a block is main text, by its own words and links and those of the blocks around it.

    Words of neighbours inside links do not count: a line beside a menu is no text for that.
    """
    words, next_words = block["words"], F.coalesce(after["words"] - after["links"], F.lit(0))
    last_words = F.coalesce(before["words"] - before["links"], F.lit(0))
    after_menu = F.coalesce(9 * before["links"] > 5 * before["words"], F.lit(False))
    among_text = (words > 16) | (next_words > 15) | (last_words > 4)
    behind_menu = (words > 40) | (next_words > 17)
    return (3 * block["links"] <= words) & F.when(after_menu, behind_menu).otherwise(among_text)


def main_blocks(html: Column) -> Column:
    """``text_blocks`` with a field ``main``."""

    def judged(blocks: Column) -> Column:
        def judge(block: Column, at: Column) -> Column:
            before = F.when(at > 0, F.get(blocks, at - 1))
            return block.withField("main", is_main(block, before, F.get(blocks, at + 1)))

        return F.transform(blocks, judge)

    return let(text_blocks(html), judged)


def main_text(html: Column) -> Column:
    """The main blocks' texts, a space between them; '' where no block is main text."""
    kept = F.filter(main_blocks(html), lambda b: b["main"])
    return F.array_join(F.transform(kept, lambda b: b["text"]), " ")
