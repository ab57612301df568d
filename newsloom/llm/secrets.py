"""Secret scans: fixed patterns, and random strings told from identifiers by Markov models.

The values that the fixed patterns find are labelled as random strings. Long tokens outside them
that hardly switch between letters and digits are labelled as ordinary: words, paths, host names,
versions and plain numbers alike, so that holding digits says nothing by itself. Character pairs of
both are counted over all rows.
A long token is reported where the log-likelihood ratio of the two models is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.spans import gated, matches
from newsloom.session import materialize

ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9=]"
ALPHABET = "".join(chr(c) for c in range(0x2B, 0x7B) if chr(c).isalnum() or chr(c) in "+/_.=-")
RANDOM_SMOOTHING, ORDINARY_SMOOTHING = 5.0, 0.5
MOST_SWITCHES = 2  # between letters and digits, of a token labelled as ordinary
LEAST_RATIO = 8.0
LEAST_PER_PAIR = 0.4


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>>, kind by its place in KINDS, of the fixed patterns.

    ``value`` is what would be the secret. Assigned values under six characters are dropped
    after matching; for the other kinds the least length is part of the pattern, which finds
    the same since their runs are matched as a whole.
    """
    sets = []
    for kind, (pattern, group) in enumerate(((ASSIGN, 1), (ACCESS, 0), (HEX, 0))):
        found = gated(F.rlike(text, F.lit(pattern)), matches(text, F.lit(pattern), group))
        if group:
            found = F.filter(found, lambda m: F.char_length(m["value"]) >= 6)
        sets.append(_of_kind(found, kind))
    return F.concat(*sets)


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and long tokens that touch none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", base_spans(text).alias("base"), _tokens(text).alias("tokens"))
    apart = F.filter(
        "tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )
    return found.select("doc_id", "base", apart.alias("tokens"))


def _tokens(text: Column) -> Column:
    return gated(F.rlike(text, F.lit(TOKEN)), matches(text, F.lit(TOKEN)))


def labelled(rows: DataFrame) -> DataFrame:
    """(v, y) from rows of ``scanned``: random strings with y = 1, ordinary ones with y = 0, copies once."""
    ordinary = F.filter(
        "tokens", lambda t: F.regexp_count(t["value"], F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")) <= MOST_SWITCHES
    )
    of = lambda spans, y: rows.select(F.explode(F.transform(spans, lambda s: s["value"])).alias("v"), F.lit(y).alias("y"))
    return of(F.col("base"), 1).unionByName(of(ordinary, 0)).groupBy("v", "y").agg(F.lit(1).alias("once"))


def pair_ratios(rows: DataFrame) -> list[float]:
    """log P(b | a) in random strings less that in identifiers, for all pairs of ALPHABET in order.

    Counts are over all rows of ``scanned``; the driver gets at most one count per pair and class.
    """
    texts = labelled(rows)
    place = F.sequence(F.lit(1), F.char_length("v") - 1)
    pairs = texts.where(F.char_length("v") > 1).select(
        "y", F.explode(F.transform(place, lambda i: F.substr(F.col("v"), i, F.lit(2)))).alias("pair")
    )
    counts = {(r["pair"], r["y"]): r["n"] for r in pairs.groupBy("pair", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in ALPHABET:
        after = [sum(counts.get((a + b, y), 0) for b in ALPHABET) for y in (0, 1)]
        for b in ALPHABET:
            odds = []
            for y, smooth in ((1, RANDOM_SMOOTHING), (0, ORDINARY_SMOOTHING)):
                odds.append((counts.get((a + b, y), 0) + smooth) / (after[y] + smooth * len(ALPHABET)))
            out.append(round(math.log(odds[0] / odds[1]), 4))
    return out


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the pair ratios of a token."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1
    pairs = F.sequence(F.lit(1), F.char_length(token) - 1)
    add = lambda sum_, i: sum_ + F.get(table, at(i) * len(ALPHABET) + at(i + 1))
    return F.aggregate(pairs, F.lit(0.0), add)


def looks_random(token: Column, ratios: list[float], least_ratio: float, least_per_pair: float) -> Column:
    """Whether a token's ratio is high enough; none is if ``ratios`` says nothing."""
    if not any(ratios):
        return F.lit(False)
    least = F.greatest(F.lit(least_ratio), F.lit(least_per_pair) * (F.char_length(token) - 1))
    return likelihood_ratio(token, ratios) >= least


def held_out_rates(docs: DataFrame, least_ratio: float = LEAST_RATIO, least_per_pair: float = LEAST_PER_PAIR) -> DataFrame:
    """How models of two thirds of the rows judge the labelled strings of the others.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out (null doc_id: learned from). Columns
    y (1 random, 0 ordinary), n (different strings of a token's least length) and n_random (those
    judged random); strings that were also learned from are left out. No rows: no labels.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = materialize(scanned(docs).withColumn("out", out), "secrets-held-out")
    learned, kept = rows.where(~F.col("out")), rows.where("out")
    judged = labelled(kept).join(labelled(learned).select("v", "y"), ["v", "y"], "left_anti")
    judged = judged.where(F.char_length("v") >= 16)
    random = looks_random(F.col("v"), pair_ratios(learned), least_ratio, least_per_pair)
    return judged.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(random).alias("n_random"))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, least_ratio: float = LEAST_RATIO, least_per_pair: float = LEAST_PER_PAIR) -> DataFrame:
    """doc_id and ``spans``: array<struct<start, kind, end, value>> of whole texts.

    ``kind`` is the place in KINDS; places are code points, the end exclusive. Spans of the
    fixed patterns always stay; 'random' spans touch none of them.

    Null or empty text: no spans. Null doc_id: kept. Repeated rows: each its spans; equal
    samples train the models once. Without samples the models are uniform and nothing is
    added. Empty input: no rows. Other columns are not looked at.
    """
    rows = materialize(scanned(docs), "secrets-scanned")
    ratios = pair_ratios(rows)
    added = F.filter("tokens", lambda t: looks_random(t["value"], ratios, least_ratio, least_per_pair))
    return rows.select("doc_id", F.concat("base", _of_kind(added, KINDS.index("random"))).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts per fixed kind, a digest of the fixed spans, and all spans as text."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.filter("spans", lambda s: s["kind"] < KINDS.index("random")))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
