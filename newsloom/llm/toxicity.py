"""Toxicity by a learned lexicon, matched with misspellings, and the words around each match.

Words and word beginnings that mark toxic rows are learned from a bounded sample of labelled
rows. They form a trie; a word of a text is an automaton that accepts everything within one
edit, and walking both together finds the terms it may stand for. Each match is judged by its
window of words: inside quotation marks or near words that report speech it counts apart from
a plain one, and windows with several plain matches count most. A logistic regression on
these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import in_batches
from newsloom.session import materialize

ROWS_PER_CLASS = 15_000
MOST_TERMS = 2_000
LEAST_CONTEXTS = 12
LEAST_TEXTS = 8
PURITY = 30.0
SHORTEST_FUZZY = 5
WINDOW = 8
THRESHOLD = 0.7
STEMS = range(4, 8)
# Known from the start; everything else is learned.
SEED_TERMS = (
    "asshole bastard bitch coward disgusting dumb fool fuck garbage idiot imbecile jerk liar loser moron pathetic "
    "scum shit stupid trash ugly vermin worthless"
).split()
SEED_WEIGHT = 5.0
# Of ``features`` and the constant, where there are no labels to learn from.
UNTRAINED = (0.5, 0.0, 0.1, 0.0, 0.2, 0.8, 0.1, 1.0, 0.0, 0.0, 0.0, -3.0)
REPORTING = frozenset(
    "said says say called calls calling quoted quotes quote wrote writes word words term terms insult insults slur "
    "slurs phrase means meaning defined definition reported cited reads article".split()
)
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”«»]")
WORD_SQL = r"[\p{L}\p{N}]+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Lexicon:
    """A trie of words and of stems (word beginnings), each with the weight of its evidence."""

    words: dict[str, float]
    stems: dict[str, float]
    root: dict = field(default_factory=dict)
    heads: frozenset[str] = frozenset()
    middles: frozenset[str] = frozenset()

    def __post_init__(self):
        for term in {*self.words, *self.stems}:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node["end"] = (term in self.words, term in self.stems, len(term) >= SHORTEST_FUZZY)
        long = [t for t in {*self.words, *self.stems} if len(t) >= SHORTEST_FUZZY]
        self.heads = frozenset(t[:2] for t in long)
        self.middles = frozenset(t[2:5] for t in long)

    def exact(self, word: str) -> float:
        """The weight of the term a word is or begins with; 0 for none."""
        return max(self.words.get(word, 0.0), *[self.stems.get(word[:n], 0.0) for n in STEMS])

    def near(self, word: str) -> bool:
        """Whether a term lies within one edit of the word, or a stem of its beginning.

        The automaton's states are bits over the word: reached without an edit, and with one.
        """
        if len(word) < SHORTEST_FUZZY - 1:
            return False
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 2 << i
        full, last = (2 << len(word)) - 1, 1 << len(word)
        stack = [(self.root, 1, 3)]
        while stack:
            node, clean, edited = stack.pop()
            if "end" in node:
                whole, stem, fuzzy = node["end"]
                if fuzzy and (whole and edited & last or stem and edited):
                    return True
            for letter, child in node.items():
                if letter == "end":
                    continue
                mask = masks.get(letter, 0)
                to = (clean << 1) & mask
                one = ((edited << 1) & mask | clean | clean << 1 | to | to << 1) & full
                if one:
                    stack.append((child, to, one))
        return False

    def candidate(self, word: str) -> bool:
        """False only where ``near`` is: an edit leaves a term's first two letters or its next three."""
        return word[:2] in self.heads or word[1:4] in self.middles or word[2:5] in self.middles or word[3:6] in self.middles


FEATURES = 11


def features(text: str | None, lexicon: Lexicon, seen: dict[str, tuple[int, float]]) -> list[float]:
    """Plain and quoted, exact and misspelled matches: their weights, numbers and density, and
    whether plain exact ones are at least one, two, three.

    ``seen`` remembers what words stand for: 0 nothing, 1 a term, 2 a term misspelled, and the weight.
    """
    lowered = (text or "").lower()
    words = WORD.findall(lowered)
    hits = []
    for word in set(words):
        stands = seen.get(word)
        if stands is None:
            weight = lexicon.exact(word)
            kind = 1 if weight else 2 if lexicon.candidate(word) and lexicon.near(word) else 0
            if len(seen) >= 500_000:
                seen.clear()
            stands = seen[word] = (kind, weight)
        if stands[0]:
            hits.append((word, stands))
    if not hits:
        return [0.0] * FEATURES
    marks = np.array([m.start() for m in QUOTES.finditer(lowered)])
    wanted, found = dict(hits), []
    for i, match in enumerate(WORD.finditer(lowered)):
        if match[0] in wanted:
            # an odd number of marks on its line so far: inside a quotation
            line = lowered.rfind("\n", 0, match.start()) + 1
            inside = int(((marks >= line) & (marks < match.start())).sum()) % 2 == 1
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = inside or not REPORTING.isdisjoint(near)
            found.append((i, *wanted[match[0]], quoted))
    plain = [i for i, _, _, quoted in found if not quoted]
    together = max((sum(abs(i - j) <= WINDOW for j in plain[k : k + 2 * WINDOW]) for k, i in enumerate(plain)), default=0)
    weights = lambda quoted: [w for _, kind, w, q in found if kind == 1 and q == quoted]
    misspelled = lambda quoted: float(np.log1p(sum(kind == 2 and q == quoted for _, kind, _, q in found)))
    return [
        float(np.log1p(sum(weights(False)))), misspelled(False), float(np.log1p(sum(weights(True)))), misspelled(True),
        float(together), max(weights(False), default=0.0), max(weights(True), default=0.0),
        min(1.0, 10.0 * len(plain) / max(1, len(words))), *[float(len(weights(False)) >= n) for n in (1, 2, 3)],
    ]


def fit_rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """As ``fit_logistic``, but no count lowers the score: columns that would are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        b = np.zeros(x.shape[1] + 1)
        b[np.append(used, True)] = fit_logistic(x[:, used], y, weight)
        if (b[:-1] >= 0).all():
            return b
        used &= b[:-1] >= 0


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method on the penalized likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ b
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        b += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return b


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    coefficients: tuple[float, ...]

    def scorer(self):
        lexicon, seen = Lexicon(self.words, self.stems), {}
        b = np.array(self.coefficients)

        def score(text: str | None) -> float:
            z = float(np.dot(b[:-1], features(text, lexicon, seen)) + b[-1])
            return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """(text, y): about ``rows_per_class`` rows of each label, or all, that are not held out.

    A row is chosen if the hash of its id falls into its class's share of the hash's range,
    so no task has to see a class whole. Because of the bound, the ids are broadcast.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = materialize(known, "toxic-known")
    shares = {r["y"]: min(1.0, rows_per_class / r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for item in {-1: 0.0, **shares}.items() for x in item])[F.col("y")]
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 4) / F.lit(2.0**60) < share)
    chosen = materialize(chosen.select(F.col("doc_id").alias("_id"), "y"), "toxic-chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), "y")


def learn_terms(
    rows: DataFrame, least: int = LEAST_CONTEXTS, purity: float = PURITY, most: int = MOST_TERMS, texts: int = LEAST_TEXTS
) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic rows, with the logarithm of how much more frequent they are there.

    A term needs ``least`` different words ahead of it in toxic rows, which copies of a text do
    not raise, and ``texts`` different texts, which repeats inside one do not raise. It must be
    ``purity`` times as frequent there, by the class's number of words, as in the other rows.
    A stem needs several words, none of which has half of its uses.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))
    each = rows.select("y", F.xxhash64("text").alias("d"), words.alias("words")).select(
        "y", "d",
        F.inline(F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", i - 1).alias("before")))),
    )
    support = [F.count_distinct("before").alias("contexts"), F.count_distinct("d").alias("texts")]
    toxic = each.where("y = 1").groupBy("word").agg(*support, F.count(F.lit(1)).alias("n1"))
    clean = each.where("y = 0").groupBy("word").agg(F.count(F.lit(1)).alias("n0"))
    counts = materialize(
        toxic.join(clean, "word", "full").select(
            "word", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("contexts", "texts", "n1", "n0")]
        ),
        "toxic-words",
    )
    totals = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).first()
    scale = (totals["n0"] or 0) / max(totals["n1"] or 0, 1)
    pure = (F.col("contexts") >= least) & (F.col("texts") >= texts) & (F.col("contexts") * scale >= purity * (F.col("n0") + 0.5))
    single = counts.where(pure & (F.char_length("word") >= 3))
    single = single.orderBy(F.desc("contexts"), "word").limit(most).collect()

    beginnings = F.array(*[F.when(F.char_length("word") > n, F.substring("word", 1, n)) for n in STEMS])
    stems = counts.select(F.explode(beginnings).alias("stem"), "contexts", "texts", "n0").where("stem is not null")
    stems = stems.groupBy("stem").agg(
        F.sum("contexts").alias("contexts"), F.sum("texts").alias("texts"), F.sum("n0").alias("n0"),
        F.max("contexts").alias("largest"), F.count(F.when(F.col("contexts") > 0, 1)).alias("kinds"),
    )
    stems = stems.where(pure & (F.col("kinds") >= 5) & (2 * F.col("largest") < F.col("contexts")))
    likely = {r["stem"]: r for r in stems.orderBy(F.desc("contexts"), "stem").limit(most).collect()}
    # sums over words may count a text more than once: the likely ones are counted again as stems
    uses = each.where("y = 1").select("d", "before", F.explode(beginnings).alias("stem")).where(F.col("stem").isin([*likely]))
    met = uses.groupBy("stem").agg(*support).where((F.col("contexts") >= least) & (F.col("texts") >= texts))
    weight = lambda r: round(max(0.5, math.log((r["contexts"] * scale + 0.5) / (r["n0"] + 0.5))), 3)
    stems = {r["stem"]: weight(likely[r["stem"]]) for r in met.select("stem").collect()}
    shortest = {s: stems[s] for s in sorted(stems) if not any(s[:n] in stems for n in range(STEMS[0], len(s)))}
    plain = {r["word"]: weight(r) for r in single if not any(r["word"][:n] in stems for n in STEMS)}
    return dict.fromkeys(SEED_TERMS, SEED_WEIGHT) | plain, shortest


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Lexicon and coefficients from a bounded sample of rows that are not held out."""
    rows = materialize(labelled_sample(docs, labels, rows_per_class), "toxic-sample")
    words, stems = learn_terms(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(words, stems), {}
        for batch in batches:
            made = [features(t, lexicon, seen) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    kind = rows.schema["y"].dataType.simpleString()
    # rows with equal features are one row with a weight; no more rows come back than the sample has
    got = in_batches(rows).mapInArrow(run, f"x array<double>, y {kind}").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if not got:
        return Model(words, stems, UNTRAINED)
    x, y, n = (np.array([r[k] for r in got], float) for k in ("x", "y", "n"))
    classes = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()
    for row in classes:
        n[y == row["toxic"]] *= row["count"] / max(n[y == row["toxic"]].sum(), 1)
    return Model(words, stems, tuple(map(float, fit_rising(x, y, n))))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): every row of ``docs`` as a struct, and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc", "score"])

    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("score", T.DoubleType())])
    return in_batches(docs).select(F.struct("*").alias("doc"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text. Columns doc_id, held_out, score (0 to 1), predicted.

    The model learns from about ``rows_per_class`` labelled rows a class, chosen by a hash
    of the id, whose id is not held out. Only the text enters a score.

    Null or empty text: no matches, the score of such rows. Null doc_id: not held out. Repeated
    rows: scored alike. A doc_id with several labels counts as toxic if one is. No labels: the
    built-in terms with fixed coefficients. Empty input: no rows.
    """
    model = fit(docs, labels, rows_per_class)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold."""
    scored = score_toxicity(docs, fit(docs, labels, rows_per_class))
    return scored.where(F.col("score") < threshold).select("doc.*")
