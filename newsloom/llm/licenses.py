"""License scans by ordered signature rules.

One search for any rule's keyword sets aside the texts without license words. In the others
the words are written out evenly, one search finds the keywords that are there, and the rules
of these are matched. Of overlapping detections those inside another go first; of the rest
that overlap in part, those of the better priority stay.
"""

from __future__ import annotations

import re
import string
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.llm.license_rules import BASE, CERTAINTY, NAME, Rule, rules

# As words of the text with A-Z in lower case. Java matches the letters that belong in half
# the time of those that do not.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HIT, HIT_END = "\x01", "\x02"  # no characters of evened texts
DETECTION = "array<struct<start:int,end:int,rank:int,priority:int,label:string>>"


def spaced(pattern: str) -> str:
    """A rule's pattern for words that have a space on both sides each."""
    return f" {pattern.replace(' ?', '~').replace(' ', '  ').replace('~', '(?:  )?')} "


def _branches(rests: list[str], letters: int, between: str) -> str:
    """Any of the texts; those with the same first letters share them, so that few are tried at most words."""
    if not letters:
        return "|".join(between.join(map(re.escape, r.split(" "))) for r in rests)
    groups = {first: list(rest) for first, rest in groupby(rests, lambda r: r[0])}
    return "|".join(f"{first}(?:{_branches([r[1:] for r in rest], letters - 1, between)})" for first, rest in groups.items())


def keyword_pattern(keywords: set[str]) -> str:
    """Finds, in a text in lower case behind a space, a keyword's words, whatever stands between them."""
    first = "".join(sorted({k[0] for k in keywords}))
    return rf"[^0-9a-z](?=[{first}])(?:{_branches(sorted(keywords), 2, BETWEEN)})"


def keywords_there(evened: Column, keywords: set[str]) -> Column:
    """The keywords at the words' beginnings, once each; at every word the longest only."""
    longest_first = sorted(keywords, key=lambda k: (k[:2], -len(k), k))
    pattern = f" (?=({_branches(longest_first, 2, '  ')}))"
    return F.array_distinct(F.regexp_extract_all(evened, F.lit(pattern), F.lit(1)))


def even(text: Column) -> Column:
    """The words in lower case (A-Z only), a space on both sides of each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    joined = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    return F.translate(joined, string.ascii_uppercase, string.ascii_lowercase)


def _rows(listed: list[Rule]) -> Column:
    """The rules as one array of structs, which is folded to a literal before any row is read."""

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def row(rank: int, rule: Rule) -> str:
        keywords = ", ".join(text(k.replace(" ", "  ")) for k in rule.keyword.split("|"))
        return (
            f"named_struct('label', {text(rule.label)}, 'keywords', array({keywords}), 'pattern', {text(spaced(rule.pattern))}, "
            f"'priority', {rule.priority}, 'rank', {rank})"
        )

    return F.expr(f"array({', '.join(row(i, r) for i, r in enumerate(listed))})")


def places(evened: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of a pattern's matches, in one search that marks them."""

    def cut(marked: Column) -> Column:
        parts = F.split(marked, HIT)
        nothing = F.array().cast("array<struct<start:int,end:int>>")
        begin = F.struct(F.char_length(parts[0]).alias("at"), nothing.alias("out"))

        def step(state: Column, part: Column) -> Column:
            end = state["at"] + F.instr(part, HIT_END) - 1
            found = F.struct(state["at"].alias("start"), end.alias("end"))
            return F.struct((state["at"] + F.char_length(part) - 1).alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

        listed = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), begin, step, lambda state: state["out"])
        return F.when(F.contains(marked, F.lit(HIT)), listed).otherwise(nothing)

    return let(F.regexp_replace(evened, pattern, F.lit(f"{HIT}$0{HIT_END}")), cut)


def detections(evened: Column, listed: list[Rule]) -> Column:
    """array<struct<start, end, rank, priority, label>> of all rules' matches."""

    def found(r: Column) -> Column:
        return F.transform(
            places(evened, r["pattern"]),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), r["rank"].alias("rank"),
                r["priority"].alias("priority"), r["label"].alias("label"),
            ),
        )

    def of_rules(there: Column) -> Column:
        live = lambda r: F.exists(there, lambda f: F.exists(r["keywords"], lambda k: F.startswith(f, k)))
        return F.flatten(F.transform(F.filter(_rows(listed), live), found))

    return let(keywords_there(evened, {k for r in listed for k in r.keyword.split("|")}), of_rules)


def outermost(found: Column) -> Column:
    """Detections inside no other, by place. Of one place the better priority, then the earlier rule stays."""
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"), F.negate(d["end"]).alias("minus_end"), d["priority"].alias("priority"),
                d["rank"].alias("rank"), d["label"].alias("label"),
            ),
        )
    )
    start = F.struct(F.lit(-1).alias("reached"), F.array().cast(DETECTION).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        now = F.struct(
            d["start"].alias("start"), F.negate(d["minus_end"]).alias("end"), d["rank"].alias("rank"),
            d["priority"].alias("priority"), d["label"].alias("label"),
        )
        further = F.struct(now["end"].alias("reached"), F.concat(state["kept"], F.array(now)).alias("kept"))
        return F.when(now["end"] > state["reached"], further).otherwise(state)

    return F.aggregate(ordered, start, step, lambda state: state["kept"])


def overlapping(kept: Column) -> Column:
    """The outermost detections in groups of those that overlap one another in a row."""
    none = F.array().cast(DETECTION)
    start = F.struct(F.lit(-1).alias("reached"), F.array().cast(f"array<{DETECTION}>").alias("done"), none.alias("now"))

    def step(state: Column, d: Column) -> Column:
        joined = F.struct(d["end"].alias("reached"), state["done"].alias("done"), F.concat(state["now"], F.array(d)).alias("now"))
        fresh = F.struct(d["end"].alias("reached"), F.concat(state["done"], F.array(state["now"])).alias("done"), F.array(d).alias("now"))
        return F.when(d["start"] < state["reached"], joined).otherwise(fresh)

    return F.aggregate(kept, start, step, lambda state: F.concat(state["done"], F.array(state["now"])))


def resolved(found: Column) -> Column:
    """Detections that are not suppressed, in order of place.

    One inside another goes, whatever its priority. Of the rest, one goes if it overlaps one of
    better priority that stays; of equal priority both stay. The order of detections has no say.
    """

    def joined(group: Column, priority: int):
        """Adds to those of better priority the group's of this one that overlap none of them."""

        def apart(d: Column, better: Column) -> Column:
            return ~F.exists(better, lambda e: (e["start"] < d["end"]) & (d["start"] < e["end"]))

        own = lambda better: F.filter(group, lambda d: (d["priority"] == priority) & apart(d, better))
        return lambda better: F.concat(better, own(better))

    def ranked(group: Column) -> Column:
        kept = F.array().cast(DETECTION)
        for priority in CERTAINTY:  # from the best
            kept = let(kept, joined(group, priority))
        return F.when(F.size(group) <= 1, group).otherwise(kept)

    return F.array_sort(F.flatten(F.transform(overlapping(outermost(found)), ranked)))


def word_at(evened: Column, place: Column) -> Column:
    """Number of the word that begins after the space at ``place``: words ahead have two spaces each."""
    ahead = F.substr(evened, F.lit(1), place)
    return F.floor((F.char_length(ahead) - F.char_length(F.replace(ahead, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan_licenses(docs: DataFrame, listed: list[Rule] | None = None) -> DataFrame:
    """Label the license notices of whole texts.

    Columns doc_id, n_words, n_base, first_word, last_word (of the base phrases' places),
    base_labels, labels (base and others, sorted), score (of the surest detection, 0 without
    one) and detections (first word, words, label).

    Null or empty text: no words, no labels, score 0. Null doc_id: kept. Repeated rows: each
    its labels. Empty input: no rows. Other columns are not looked at.
    """
    listed = rules() if listed is None else listed
    base = [Rule(label, phrase, phrase, NAME) for label, phrase in BASE.items()]
    text = F.coalesce(F.col("text"), F.lit(""))
    every = {k for r in [*base, *listed] for k in r.keyword.split("|")}
    gate = F.rlike(F.concat(F.lit(" "), F.lower(text)), F.lit(keyword_pattern(every)))
    counted = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", counted.alias("n_words"), F.when(gate, even(text)).alias("evened"))
    none = F.array().cast(DETECTION)
    when = lambda c: F.when(F.col("evened").isNotNull(), c).otherwise(none)
    # one-element arrays keep each list computed once
    evened = F.col("evened")
    rows = rows.select(
        "doc_id", "n_words", "evened",
        F.inline(F.array(F.struct(when(detections(evened, base)).alias("base"), when(detections(evened, listed)).alias("found")))),
    )
    rows = rows.select("doc_id", "n_words", "evened", F.inline(F.array(F.struct("base", resolved(F.col("found")).alias("kept")))))
    places = F.transform("base", lambda d: word_at(evened, d["start"] + 1))
    spans = F.transform(
        "kept",
        lambda d: F.struct(
            word_at(evened, d["start"] + 1).alias("first"),
            (word_at(evened, d["end"]) - word_at(evened, d["start"] + 1)).alias("words"), d["label"].alias("label"),
        ),
    )
    labels = lambda c: F.array_distinct(F.transform(c, lambda d: d["label"]))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    sure = F.create_map(*[x for p, c in CERTAINTY.items() for x in (F.lit(p), F.lit(c))])
    scores = F.transform(F.concat("base", "kept"), lambda d: sure[d["priority"]])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(labels("base")).alias("base_labels"),
        joined(F.array_union(labels("base"), labels("kept"))).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
        spans.alias("detections"),
    )
