"""MinHash near-duplicates by min-max hashing.

Every permutation gives a document two signature values, the least and the greatest hash of
its shingles, so half as many hashes are evaluated as values kept. Bands of values name the
buckets in which documents meet, and every link is confirmed on the full sets.

Nothing is enumerated pair by pair where documents are crowded. Each set is first compared
with the most met member of its buckets; what is linked by that is one component. Only
members of different components that still share a bucket are compared again, in tasks
bounded by the size of their sets, each pair in the first band it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_batches, text_mark
from newsloom.llm.components import connected
from newsloom.llm.wordhash import run_hashes, word_hashes
from newsloom.session import materialize

SHINGLE = 2
PERCENT = 80
BANDS = 48
ROWS = 6
SHINGLES_PER_BLOCK = 2_000_000
_CHUNK = 2048


def missed_share(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The share of pairs of one similarity that are expected to meet in no band."""
    return (1 - similarity**rows) ** bands


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words, of the whole sequence."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    runs = run_hashes(hashes, min(words, len(hashes))) if len(hashes) else hashes
    return np.unique(runs)


def multipliers(permutations: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least and greatest hash of a non-empty set under each permutation: [p, 2]."""
    out = np.zeros((len(factors), 2), np.uint64)
    out[:, 0] = np.uint64(2**64 - 1)
    for start in range(0, len(shingles), _CHUNK):
        h = shingles[None, start : start + _CHUNK] * factors[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(out[:, 0], h.min(axis=1), out=out[:, 0])
        np.maximum(out[:, 1], h.max(axis=1), out=out[:, 1])
    return out


def band_values(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band; the band's number has part in it, so values of bands do not meet."""
    parts = signed.reshape(-1)[: bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        out = (out ^ parts[:, i]) * np.uint64(0xA0761D6478BD642F)
        out ^= out >> np.uint64(29)
    return out


def set_name(shingles: np.ndarray) -> int:
    """64 bits that name a set, from two sums over its members."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    both = int(mixed.sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(mixed)) + len(shingles)
    both %= 2**64
    return (both ^ (both >> 32)) * 0xFF51AFD7ED558CCD % 2**64


def signed_rows(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, key, n, bands): the name and size of each document's set, and its band values."""
    factors = multipliers(-(-bands * rows // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, values = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words)
                sizes.append(len(own))
                keys.append(set_name(own) if len(own) else 0)
                values.append(band_values(signature(own, factors), bands, rows).view(np.int64) if len(own) else [])
            columns = [batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)),
                       pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "key", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark binary, key bigint, n bigint, bands array<bigint>"
    return in_batches(docs).select("doc_id", text_mark(), "text").mapInArrow(run, schema)


def meetings(rows: DataFrame) -> DataFrame:
    """(value, key): the sets that share a band's value with another set."""
    entries = rows.where("n > 0").select(F.explode("bands").alias("value"), "key")
    shared = entries.groupBy("value").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("value")
    shared = materialize(shared, "minhash-shared")
    return entries.join(shared.hint("merge"), "value").distinct()


def full_sets(docs: DataFrame, rows: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, items): the shingles of the sets named in ``keys``, taken from one document each."""
    who = rows.join(keys.hint("merge"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("who"))
    who = materialize(who.select("key", F.col("who.doc_id").alias("id"), F.col("who.mark").alias("m")), "minhash-who")
    at = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("m"))
    texts = docs.select("doc_id", text_mark(), "text").join(who.hint("merge"), at).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "items"])

    return in_batches(texts).mapInArrow(run, "key bigint, items binary").distinct()


def best_met(met: DataFrame) -> DataFrame:
    """(key, pivot): for each set the member of its buckets that meets the most others."""
    crowd = met.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    degrees = met.join(crowd, "value").groupBy("key").agg(F.sum("size").alias("degree"))
    ranked = materialize(met.join(degrees, "key"), "minhash-degrees")
    top = ranked.groupBy("value").agg(F.max(F.struct("degree", "key")).alias("top"))
    best = ranked.join(top, "value").groupBy("key").agg(F.max("top").alias("top"))
    return best.select("key", F.col("top.key").alias("pivot")).where("key <> pivot")


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the pairs (key, pivot) that are similar on their full sets."""
    own = sets.select("key", "items")
    other = sets.select(F.col("key").alias("pivot"), F.col("items").alias("with"))
    both = pairs.join(own, "key").join(other, "pivot").select("key", "pivot", "items", "with")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(similar(common, len(x), len(y), percent))
            kept = batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])

    return in_batches(both).mapInArrow(run, "a bigint, b bigint")


def labelled(met: DataFrame, links: DataFrame) -> DataFrame:
    """(value, key, root) of the buckets that hold sets of more than one component."""
    roots = connected(links, "minhash-roots")
    rooted = met.join(roots, F.col("key") == F.col("node"), "left").select("value", "key", F.coalesce("root", "key").alias("root"))
    rooted = materialize(rooted, "minhash-rooted")
    mixed = rooted.groupBy("value").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("value")
    return rooted.join(mixed, "value")


def _cross_links(group: pa.Table, bands: int, percent: int) -> pa.Table:
    """Links between sets of different components in one bucket, or in two blocks of one."""
    value = group.column("value")[0].as_py()
    key = group.column("key").to_numpy()
    values = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    root, side = group.column("root").to_numpy().copy(), group.column("mine").to_numpy()
    here = int(np.flatnonzero(values[0] == value)[0])
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    items = owners = None
    found = []
    for a in np.flatnonzero(side == x):
        rest = np.flatnonzero(side == y)
        rest = rest[rest > a] if x == y else rest
        rest = rest[(root[rest] != root[a]) & (100 * np.minimum(sizes[rest], sizes[a]) >= percent * np.maximum(sizes[rest], sizes[a]))]
        if here and len(rest):  # a pair is compared in the first band it shares
            rest = rest[~(values[rest, :here] == values[a, :here]).any(axis=1)]
        if not len(rest):
            continue
        if len(rest) <= 16:
            common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in rest])
        else:
            if items is None:  # the block's inverted lists
                items, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                by_item = np.argsort(items, kind="stable")
                items, owners = items[by_item], owners[by_item]
            low, high = np.searchsorted(items, sets[a], "left"), np.searchsorted(items, sets[a], "right")
            spans = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low)
            common = np.bincount(owners[spans + np.arange(len(spans))], minlength=len(sets))[rest]
        near = rest[similar(common, sizes[rest], sizes[a], percent)]
        for other in np.unique(root[near]):
            b = near[root[near] == other][0]
            found.append((key[a], key[b]))
            root[root == other] = root[a]
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def cross_links(open_: DataFrame, rows: DataFrame, sets: DataFrame, bands: int, percent: int, most: int) -> DataFrame:
    """Links (a, b) between the components of each bucket that join all that should be one.

    A bucket whose sets hold over ``most`` shingles is dealt to blocks, and every pair of
    blocks meets in a task of its own.
    """
    wanted = open_.select("key").distinct()
    own = rows.where("n > 0").join(wanted, "key", "left_semi").select("key", "n", "bands").distinct()
    own = materialize(own.join(sets, "key"), "minhash-open-sets")
    met = open_.join(own.select("key", "n"), "key")
    blocks = met.groupBy("value").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    dealt = met.join(blocks, "value").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("value", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "key", "root", "mine")
    # blocks of one bucket: within x = y, else only across
    full = dealt.join(own.select("key", "bands", "items"), "key")

    def run(group: pa.Table) -> pa.Table:
        return _cross_links(group, bands, percent)

    return full.groupBy("value", "x", "y").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    most: int = SHINGLES_PER_BLOCK,
) -> DataFrame:
    """Set size and component of each document.

    Documents are linked if their sets of distinct shingles have a Jaccard similarity of
    ``percent`` or more. Columns doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept (doc_id = component_id). A link that meets in no band is lost: ``missed_share`` of
    the links just at the threshold, 5 in 10 million with the given bands, fewer above.

    Null, empty and blank text: no shingles, linked with nothing, a component of its own.
    Fewer words than a shingle: one shingle of all words. Null doc_id: takes part; counts as
    a component's id only if all others are null too, and is then kept. Repeated rows stay,
    each with its component. Empty input: no rows. Other columns are not looked at.
    """
    signed = materialize(signed_rows(docs, words, bands, rows), "minhash-rows")
    met = materialize(meetings(signed), "minhash-met")
    sets = materialize(full_sets(docs, signed, met.select("key").distinct(), words), "minhash-sets")
    links = materialize(confirmed(materialize(best_met(met), "minhash-pairs"), sets, percent), "minhash-first")
    open_ = materialize(labelled(met, links), "minhash-open")
    more = materialize(cross_links(open_, signed, sets, bands, percent, most), "minhash-second")
    roots = connected(links.unionByName(more), "minhash-links")
    lowest = signed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    placed = lowest.join(roots, F.col("key") == F.col("node"), "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    placed = materialize(placed, "minhash-placed")
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(placed.join(named, "root").select("key", "component_id"), "minhash-named")
    every = signed.select("doc_id", "key", "n").join(named, "key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return every.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
