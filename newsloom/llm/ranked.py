"""Ranked lexical search over an index of shards, by Block-Max MaxScore.

A shard is a run of documents of one task, closed by its number of words; its posting lists
are cut in blocks, and a block keeps the largest occurrence count and the smallest document
length in it. Lists whose bounds together cannot reach the worst of the best so far are not
essential: they bring no candidates, and a candidate of the others is looked up in one of
their blocks only if that block's maximum can still bring it in. Shards' best rows are merged
by rank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.common import in_batches
from newsloom.session import materialize

WORDS_PER_SHARD = 2_000_000
POSTINGS_PER_BLOCK = 128
ITEMS_PER_BLOCK = 512
DOCUMENTS_PER_WINDOW = 2048
UNIT = 1_000_000_000

_SPACED = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 32 for b in range(256)
)
INDEX = "shard bigint, term string, block int, first int, last int, size int, most int, least bigint, body binary"
HIT = "item_id {kind}, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """Stretches of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def pack(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative values as bytes of seven bits, the last of each marked; and where each run ends."""
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        width += values >= 1 << bits
    at = np.concatenate([[0], np.cumsum(width)])
    nth = np.arange(at[-1]) - np.repeat(at[:-1], width)
    out = (np.repeat(values, width) >> (7 * nth)) & 127
    out[at[1:] - 1] |= 128
    return out.astype(np.uint8), at[ends]


def unpack(body: bytes) -> np.ndarray:
    data = np.frombuffer(body, np.uint8).astype(np.int64)
    ends = np.flatnonzero(data >= 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    nth = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127) << (7 * nth), starts) if len(ends) else np.zeros(0, np.int64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def shard_rows(name: int, ids: list[int], texts: list[np.ndarray], numbers: dict[bytes, int], per_block: int) -> pa.RecordBatch:
    """The index rows of one shard: its blocks, and one row without a term for its documents.

    ``texts`` hold the numbers of each document's terms.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    term = np.concatenate(texts).astype(np.int64)
    vocabulary = np.array(list(numbers), dtype=object)
    order = np.array(sorted(range(len(vocabulary)), key=vocabulary.__getitem__), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, tf = np.unique(place[term] << 32 | np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, doc = codes >> 32, codes & (2**32 - 1)
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    nth = np.arange(len(term)) - np.repeat(begins, np.diff(np.append(begins, len(term))))
    starts = np.flatnonzero(nth % per_block == 0)
    ends = np.append(starts[1:], len(term))
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    body, at = pack(np.stack([gap, tf], axis=1).ravel(), 2 * ends)
    docs = np.concatenate([np.array(ids, np.int64), lengths]).tobytes()
    n = len(starts) + 1
    last = lambda values, more, kind: pa.array(np.append(values, more), kind)
    words = [w.decode("utf-8", "replace") for w in vocabulary[order[term[starts]]]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, name)), pa.array([*words, None], pa.string()), last(nth[starts] // per_block, 0, pa.int32()),
            last(doc[starts], 0, pa.int32()), last(doc[ends - 1], len(ids), pa.int32()), last(ends - starts, len(ids), pa.int32()),
            last(np.maximum.reduceat(tf, starts), 0, pa.int32()),
            last(np.minimum.reduceat(lengths[doc], starts), lengths.sum(), pa.int64()),
            pa.concat_arrays([_binary(body, at), pa.array([docs], pa.binary())]),
        ],
        ["shard", "term", "block", "first", "last", "size", "most", "least", "body"],
    )


def build_index(docs: DataFrame, words_per_shard: int = WORDS_PER_SHARD, per_block: int = POSTINGS_PER_BLOCK) -> DataFrame:
    """Index rows of all documents with at least one term and an id, to be stored by the caller.

    No row moves: each task cuts its documents into shards. A shard's blocks are in order of
    term, and its row without a term names its documents, their number (``size``) and words
    (``least``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, words = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        texts: list[np.ndarray] = []
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = terms_of(text)
                if not own:
                    continue
                ids.append(i)
                texts.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                words += len(own)
                if words >= words_per_shard:
                    yield shard_rows(task << 32 | made, ids, texts, numbers, per_block)
                    made, words, ids, texts, numbers = made + 1, 0, [], [], defaultdict(count().__next__)
        if ids:
            yield shard_rows(task << 32 | made, ids, texts, numbers, per_block)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each term of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            who = np.repeat(np.arange(len(found)), [len(f) for f in found])
            words = pa.array([w.decode("utf-8", "replace") for f in found for w in f], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), words], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string")


def weight(df: Column, n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double"))).cast("long")


class Lists:
    """The blocks of one shard, decompressed when first asked for."""

    def __init__(self, table: pd.DataFrame, documents: int, words: int):
        head = table[table["term"].isna()].iloc[0]
        both = np.frombuffer(head["body"], np.int64)
        self.ids, lengths = both[: len(both) // 2], both[len(both) // 2 :]
        self.length_part = lambda n: 20 * (50 + 50 * n * documents // words)
        self.part = self.length_part(lengths)
        blocks = table[table["term"].notna()].sort_values(["term", "block"])
        top = UNIT * blocks["most"].to_numpy(np.int64)
        top = top // (1000 * blocks["most"].to_numpy(np.int64) + self.length_part(blocks["least"].to_numpy(np.int64)))
        self.bodies = blocks["body"].to_numpy()
        self.first, self.last, self.top = blocks["first"].to_numpy(np.int64), blocks["last"].to_numpy(np.int64), top
        names = blocks["term"].to_numpy()
        starts = np.flatnonzero(np.append([True], names[1:] != names[:-1])) if len(names) else []
        ends = np.append(starts[1:], len(names)) if len(names) else []
        self.spans = {names[s]: (int(s), int(e)) for s, e in zip(starts, ends)}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their parts of the score, before the term's weight."""
        if number not in self.open:
            values = unpack(self.bodies[number])
            doc, tf = np.cumsum(values[::2]) + self.first[number], values[1::2]
            self.open[number] = doc, UNIT * tf // (1000 * tf + self.part[doc])
        return self.open[number]


def best_rows(lists: Lists, terms: list[tuple[str, int]], limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``limit`` best documents of the shard."""
    known = [(lists.spans[t], w) for t, w in terms if t in lists.spans and w > 0]
    known = [(s, e, w, w * int(lists.top[s:e].max())) for (s, e), w in known]
    known.sort(key=lambda x: x[3])
    ahead = np.concatenate([[0], np.cumsum([x[3] for x in known])]).astype(np.int64)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    worst = 1  # what a row must reach
    for low in range(0, len(lists.ids), window):
        high = min(low + window, len(lists.ids))
        essential = int(np.searchsorted(ahead[1:], worst, "left"))  # lists ahead cannot reach it together
        sums = np.zeros(high - low, np.int64)
        for s, e, w, _ in known[essential:]:
            for number in range(s + int(np.searchsorted(lists.last[s:e], low)), s + int(np.searchsorted(lists.first[s:e], high))):
                doc, part = lists.block(number)
                inside = slice(*np.searchsorted(doc, (low, high)))
                sums[doc[inside] - low] += w * part[inside]
        there = np.flatnonzero(sums)
        own, there = sums[there], there + low
        for at in range(essential - 1, -1, -1):
            alive = own + ahead[at + 1] >= worst
            own, there = own[alive], there[alive]
            if not len(there):
                break
            s, e, w, _ = known[at]
            number = s + np.searchsorted(lists.last[s:e], there)
            safe = np.minimum(number, e - 1)
            top = np.where((number < e) & (lists.first[safe] <= there), w * lists.top[safe], 0)
            asked = np.flatnonzero((top > 0) & (own + ahead[at] + top >= worst))
            passed = (top > 0) & (own + ahead[at] + top < worst)
            for one in np.unique(number[asked]):
                doc, part = lists.block(int(one))
                mine = asked[number[asked] == one]
                place = np.minimum(np.searchsorted(doc, there[mine]), len(doc) - 1)
                own[mine] += np.where(doc[place] == there[mine], w * part[place], 0)
            own, there = own[~passed], there[~passed]
        good = own >= worst
        docs, scores = np.append(docs, there[good]), np.append(scores, own[good])
        if len(scores) > limit:
            best = np.lexsort((lists.ids[docs], -scores))[:limit]
            docs, scores = docs[best], scores[best]
        if len(scores) == limit:
            worst = max(worst, int(scores.min()))
    return docs, scores


def search(index: DataFrame, items: DataFrame, limit: int = 50, window: int = DOCUMENTS_PER_WINDOW) -> DataFrame:
    """The ``limit`` highest-scoring documents of each item, from a stored index.

    Columns item_id, rank, doc_id, score; scores above 0 only, equal ones by doc_id. Weights
    and lengths follow the whole index: a term's weight is floor(1000 ln((2N+2)/(2df+1))), its
    part in a score weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N div L).

    Items are dealt in blocks, and a block meets each shard in a task of its own. Null, empty
    and term-less items and those of unknown terms only: no rows. Null item_id: an item like
    any other. An item that is repeated under its id: its terms together, once. Null texts of
    documents and null ids are not in the index. Repeated documents are ranked each. Texts of
    any length are taken whole. Empty input: no rows. Other columns are not looked at.
    """
    totals = index.where("term is null").agg(F.sum("size").alias("n"), F.sum("least").alias("l")).first()
    documents, words = int(totals["n"] or 0), int(totals["l"] or 0)
    kind = items.schema["item_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("item_id"), F.lit(-(-items.count() // ITEMS_PER_BLOCK) or 1)).cast("int")
    asked = materialize(item_terms(items).distinct(), "ranked-terms")
    wanted = materialize(index.join(asked.select("term").distinct(), "term"), "ranked-lists")
    counts = wanted.groupBy("term").agg(F.sum("size").alias("df"))
    weighed = asked.join(counts, "term").select("item_id", "term", weight(F.col("df"), documents).alias("w"))
    weighed = materialize(weighed.withColumn("part", part), "ranked-weights")
    parts = weighed.select("part").distinct()
    heads = index.where("term is null").crossJoin(parts)  # one row a shard, for each block of items
    lists = wanted.join(weighed.select("part", "term").distinct(), "term").select(heads.columns).unionByName(heads)
    questions = weighed.groupBy("part", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    shards = index.where("term is null").select("shard")
    to = [F.col("shard").alias("to_shard"), F.col("part").alias("to_part")]
    questions = questions.crossJoin(shards).select(*to, "item_id", "terms")  # the stated items, to each shard

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Lists(left.select(["term", "block", "first", "last", "most", "least", "body"]).to_pandas(), documents, words)
        who, ids, scores = [], [], []
        for at, terms in enumerate(right.column("terms").to_pylist()):
            docs, score = best_rows(found, [(t["term"], t["w"]) for t in terms], limit, window)
            who.append(np.full(len(docs), at))
            ids.append(found.ids[docs])
            scores.append(score)
        taken = right.column("item_id").combine_chunks().take(pa.array(np.concatenate(who), pa.int64()))
        return pa.table([taken, np.concatenate(ids), np.concatenate(scores)], ["item_id", "doc_id", "score"])

    met = lists.groupBy("shard", "part").cogroup(questions.groupBy("to_shard", "to_part"))
    hits = met.applyInArrow(run, HIT.format(kind=kind))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """``search`` over an index built, and stored, from ``docs``."""
    return search(materialize(build_index(docs), "ranked-index"), items, limit)
