"""Spelling variants by a variable-length gram index.

Grams of two letters are lengthened where they are frequent, so the dictionary has short rare
grams and long common ones. A word is cut into its longest grams, those inside another left
out. One edit can touch only so many grams of a word; all others are in any word one edit
away, so two such words share at least that many. Words meet under their rarest grams, enough
of them that no pair is lost; where they meet, the lists of all their grams are merged by
counting, and what reaches the bound of either word is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_batches
from newsloom.session import materialize

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SHORTEST, LONGEST = 2, 4
LENGTHENED = 4_000
WORDS_PER_BLOCK = 4_000
_FLUSH = 300_000
_CELLS = 1_000_000
_START, _END = 1, 2

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)  # of Latin-1, A-Z in lower case


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, as UTF-8."""
    kept = (text or "").encode("latin-1", "replace").translate(_LETTERS)
    return (kept if kept.isascii() else kept.decode("latin-1").encode()).split()


def add_words(found: Counter, doc_id: int | None, text: str | None, least: int = LEAST_LENGTH) -> None:
    """Count a document's words: its runs, of which one in 199 loses a letter by its hash.

    No word gets longer, so runs of less than ``least`` bytes are left out at once.
    """
    runs = [r for r in runs_of(text) if len(r) >= least]
    found.update(runs)
    crc, ahead = zlib.crc32, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run in [r for r in set(runs) if not crc(r, ahead) % 199]:
        letters = run.decode()
        at = crc(run, ahead) % len(letters)
        times = runs.count(run)
        found[run] -= times
        found[(letters[:at] + letters[at + 1 :]).encode()] += times


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters that occur ``times`` times or more."""

    def rows(found: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in ((w.decode(), n) for w, n in found.items() if n) if len(w) >= least]
        words = pa.array([w for w, _ in kept], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add_words(found, doc_id, text, least)
                if len(found) >= _FLUSH:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    counted = in_batches(docs).select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def marked(word: str) -> bytes:
    """A word's Latin-1 letters between a mark of its start and one of its end."""
    return bytes([_START]) + word.encode("latin-1") + bytes([_END])


def lengthened_grams(words: DataFrame, shortest: int, longest: int, most: int) -> frozenset[bytes]:
    """The grams of the dictionary that have longer ones: of each length, those that make up over 1 in ``most``.

    There are fewer than ``most`` of each length, whatever the number of words.
    """
    found: set[bytes] = set()
    ends = F.concat(F.lit("\x01"), F.col("word"), F.lit("\x02"))
    rows = words.select(ends.alias("w"))
    for length in range(shortest, longest):
        at = F.sequence(F.lit(1), F.char_length("w") - length + 1)
        grams = rows.select(F.explode(F.transform(at, lambda i, n=length: F.substr("w", i, F.lit(n)))).alias("gram"))
        counts = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "spelling-grams")
        total = counts.agg(F.sum("n")).first()[0] or 0
        common = counts.where(F.col("n") * most > total).select("gram").collect()
        found |= {r["gram"].encode("latin-1") for r in common if length == shortest or r["gram"].encode("latin-1")[:-1] in found}
    return frozenset(found)


def decomposed(word: bytes, lengthened: frozenset[bytes], shortest: int, longest: int) -> list[tuple[int, int]]:
    """(start, end) of the word's grams: the longest of the dictionary at each place, but not inside one before."""
    grams, reached, size = [], 0, len(word)
    for start in range(size - shortest + 1):
        end = start + shortest
        while end < size and end - start < longest and word[start:end] in lengthened:
            end += 1
        if end > reached:
            grams.append((start, end))
            reached = end
    return grams


def least_common(grams: list[tuple[int, int]], size: int, longest: int) -> int:
    """How many grams at least a word shares with any word one edit away.

    A gram's own letters decide its length. An edit before it can only bring a gram that
    covers it, which must then reach from the edit over its end.
    """
    most = 0
    for at in range(1, size):  # a letter before ``at`` inserted; one at ``at`` replaced or left out
        inserted = changed = 0
        for start, end in grams:
            if start < at:
                inserted += at < end
                changed += at < end
            else:
                inserted += at + longest > end
                changed += at == start or at + longest >= end
        most = max(most, inserted, changed if at < size - 1 else 0)
    return len(grams) - most


def gram_rows(words: DataFrame, lengthened: frozenset[bytes], shortest: int, longest: int) -> DataFrame:
    """(word, least, grams): each word's grams as numbers, and how many of them stay after any edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, grams = [], []
            for word in batch.column(0).to_pylist():
                letters = marked(word)
                cut = decomposed(letters, lengthened, shortest, longest)
                bounds.append(least_common(cut, len(letters), longest))
                grams.append([int.from_bytes(letters[s:e], "big") for s, e in cut])
            columns = [batch.column(0), pa.array(bounds, pa.int32()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "least", "grams"])

    return words.select("word").mapInArrow(run, "word string, least int, grams array<bigint>")


def meeting_rows(rows: DataFrame) -> DataFrame:
    """(gram, word, least, grams) for the rarest grams of each word: all but ``least`` - 1.

    Of two words that share ``least`` grams, the rarest they share is then among these of both.
    """
    each = rows.select("word", "least", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ordered = each.join(often, "gram").groupBy("word").agg(
        F.first("least").alias("least"), F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("ranked")
    )
    rare = F.slice("ranked", F.lit(1), F.size("ranked") - F.greatest("least", F.lit(1)) + 1)
    rare = F.array_distinct(F.transform(rare, lambda r: r["gram"]))
    return ordered.select(F.explode(rare).alias("gram"), "word", "least", F.col("ranked.gram").alias("grams"))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters each two rows have in common from their first on."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_in_group(words: list[str], least: np.ndarray, ends: np.ndarray, grams: np.ndarray, side: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one edit among words that share a gram, each once; of two blocks, across only.

    Word i has the grams from ``ends[i - 1]`` to ``ends[i]``. The lists of its grams are merged
    by counting how often each other word is in them.
    """
    order = np.argsort([len(w) for w in words], kind="stable")  # a word is compared with those of its length and the next
    letters = [words[i].encode("latin-1") for i in order]
    lengths = np.fromiter(map(len, letters), np.int64, len(letters))
    width, n = int(lengths[-1]) + 1, len(letters)  # rows end in a 0, which is no letter
    front = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in letters), np.uint8).reshape(n, width)
    back = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in letters), np.uint8).reshape(n, width)
    least, side = np.maximum(least[order], 1), side[order]
    sizes = np.diff(ends, prepend=0)[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    moved = np.repeat((ends[order] - sizes) - starts[:-1], sizes) + np.arange(starts[-1])
    _, gram = np.unique(grams[moved], return_inverse=True)
    entries = np.sort(gram * n + np.repeat(np.arange(n), sizes))  # the lists, one behind the other
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < n:
        last = int(np.searchsorted(lengths, lengths[begin] + 1, "right"))
        same = int(np.searchsorted(lengths, lengths[begin], "right"))
        stop = min(same, begin + max(1, _CELLS // (last - begin)))
        own = gram[starts[begin] : starts[stop]]
        low, high = np.searchsorted(entries, own * n + begin), np.searchsorted(entries, own * n + last)
        total = np.cumsum(high - low)
        who = np.repeat(np.repeat(np.arange(stop - begin), sizes[begin:stop]), high - low)
        met = entries[np.repeat(low - (total - (high - low)), high - low) + np.arange(total[-1])] % n - begin
        shared = np.bincount(who * (last - begin) + met, minlength=(stop - begin) * (last - begin)).reshape(-1, last - begin)
        a, b = np.nonzero(shared >= np.maximum(least[begin:stop, None], least[None, begin:last]))
        ok = a < b
        if split:
            ok &= side[a + begin] != side[b + begin]
        a, b = a[ok] + begin, b[ok] + begin
        for s in range(0, len(a), _CELLS // 16):
            x, y = a[s : s + _CELLS // 16], b[s : s + _CELLS // 16]
            near = _agreeing(front[x], front[y]) + _agreeing(back[x], back[y]) >= lengths[y] - 1
            left.append(order[x[near]])
            right.append(order[y[near]])
        begin = stop
    return np.concatenate(left), np.concatenate(right)


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, lengthened: int = LENGTHENED, most: int = WORDS_PER_BLOCK) -> DataFrame:
    """(word, near) for all stored words that one inserted, deleted or replaced letter tells apart, both ways.

    Words with no gram that surely stays would need another way; with marks at both ends there
    are none of ``2 * longest - 2`` letters or more. Shorter ones are looked up under all
    words one letter shorter or with one letter left out.
    """
    plain = 2 * longest - 2
    long_words = words.where(F.char_length("word") >= plain - 1)  # partners may be one letter shorter
    chosen = lengthened_grams(long_words, shortest, longest, lengthened)
    rows = materialize(gram_rows(long_words, chosen, shortest, longest), "spelling-words")
    met = materialize(meeting_rows(rows), "spelling-met")
    blocks = met.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = blocks.select("gram", F.ceil(F.col("m") / most).cast("int").alias("blocks"))
    dealt = met.join(blocks, "gram").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gram", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "word", "least", "grams")
    dealt = dealt.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y")

    def group_pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
        words = part.column("word").combine_chunks()
        grams = part.column("grams").combine_chunks()
        split = part.column("x")[0].as_py() != part.column("y")[0].as_py()
        ends = np.cumsum(pc.list_value_length(grams).to_numpy())
        bounds, side = part.column("least").to_numpy().astype(np.int64), part.column("mine").to_numpy()
        a, b = near_in_group(words.to_pylist(), bounds, ends, grams.flatten().to_numpy(), side, split)
        if len(a):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b))], ["word", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last group so far: it may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            keys = np.stack([rows.column(c).to_numpy() for c in ("gram", "x", "y")], axis=1)
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            kept = rows.slice(bounds[-1])
            for s, e in zip(bounds, bounds[1:]):
                if e - s > 1:
                    yield from group_pairs(rows.slice(s, e - s))
        if kept is not None and kept.num_rows > 1:
            yield from group_pairs(kept)

    long_pairs = dealt.mapInArrow(run, "word string, near string")
    pairs = long_pairs.unionByName(_short_pairs(words.where(F.char_length("word") < plain)))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct()


def _short_pairs(words: DataFrame) -> DataFrame:
    """Pairs among words of few letters: equal after leaving out a letter of either or of both."""
    places = F.sequence(F.lit(1), F.char_length("word"))
    cut = lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))
    left = words.select("word", F.posexplode(F.transform(places, cut)).alias("at", "rest"))
    same = left.alias("a").join(left.alias("b"), ["rest", "at"]).where("a.word < b.word").select("a.word", F.col("b.word").alias("near"))
    shorter = left.join(words.select(F.col("word").alias("near")), F.col("rest") == F.col("near")).select("word", "near")
    return same.unionByName(shorter)


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """The form and root of every word of at least ``least`` letters and ``times`` occurrences.

    Columns word, n (occurrences), n_near (words one edit away), form (the near word of most
    occurrences, of equal ones the first by code points, if it has ``ratio`` times as many or
    more, else null), form_n (its occurrences), root (the last word reached over forms, the
    word itself without one).

    Null, empty and blank texts: no words. Null doc_id: hashed as an empty text. Repeated rows
    count each. Texts and words of any length are taken whole. Empty input: no rows. Other
    columns are not looked at.
    """
    words = materialize(vocabulary(docs, least, times), "spelling-vocabulary")
    pairs = materialize(near_words(words), "spelling-near")
    named = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(F.negate("near_n").alias("minus_n"), "near")).alias("best")
    )
    enough = F.negate("best.minus_n") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.negate("best.minus_n")).alias("form_n"),
    )
    rows = materialize(rows, "spelling-forms")
    return rows.join(roots(rows), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by doubling: each round follows twice as many forms.

    A form occurs more often than its word, so there are no circles.
    """
    steps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        steps = materialize(steps, "spelling-roots")
        further = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        met = steps.join(further, F.col("root") == F.col("_at"), "left")
        steps = met.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        steps = materialize(steps, "spelling-steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")
