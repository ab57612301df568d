"""Keyword search over an index of character trigrams, with the rows of the LIKE scan.

The corpus is stored newest first in blocks, one folder each; beside it, sorted by trigram,
the rows of every block that hold the trigram in title or content. A text of three letters or
more, wildcards aside, is looked up under all its trigrams: blocks that lack one are not
opened, and in the others only rows that hold all are compared. A common trigram has one list
a part of a block, so no list is longer than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from newsloom.functions.binding import let
from newsloom.operators.filters import keyword_match, where_corpus
from newsloom.operators.search import article_projection, check_range, keyword_search, newest_first
from newsloom.session import materialize, work_path

GRAM = 3
ROWS_PER_BLOCK = 20_000
FIRST_BLOCKS = 4
MOST_LISTED_BLOCKS = 1_000
SHARDS = 64
PART_ROWS, PART_LETTERS = 2_000, 2_000_000
LISTS = "block int, part int, gram string, rows array<int>"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; cut from its letters, so the time is linear in its length."""

    def cut(letters: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(letters) - GRAM)
        return F.when(
            F.size(letters) >= GRAM,
            F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(letters, i + k) for k in range(GRAM)]))),
        ).otherwise(F.array().cast("array<string>"))

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), cut)


def needed(q: str) -> list[str]:
    """The trigrams that a row matching ``q`` holds; % and _ may stand for anything, so none span them."""
    parts = re.split("[%_]", q.lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def _posted(rows: list[int], texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of some rows, where each one's list begins, and the lists end to end."""
    letters = np.frombuffer("".join(t for row in texts for t in row).encode("utf-32-le"), "<u4")
    pieces = [(at, len(t)) for at, row in enumerate(texts) for t in row]
    owner = np.repeat([at for at, _ in pieces], [n for _, n in pieces])
    piece = np.repeat(np.arange(len(pieces)), [n for _, n in pieces])
    whole = np.flatnonzero(piece[: 1 - GRAM] == piece[GRAM - 1 :])
    known, symbol = np.unique(letters, return_inverse=True)
    gram = np.zeros(len(whole), np.int64)
    for k in range(GRAM):
        gram = gram * len(known) + symbol[whole + k]
    if len(known) ** GRAM * len(rows) < 1 << 62:
        names = None
    else:
        names, gram = np.unique(gram, return_inverse=True)
    pairs = np.unique(gram * len(rows) + owner[whole])
    gram, row = np.divmod(pairs, len(rows))
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[starts] if names is None else names[gram[starts]]
    coded = np.stack([known[gram // len(known) ** k % len(known)] for k in reversed(range(GRAM))], axis=1)
    spelled = coded.astype("<u4").tobytes().decode("utf-32-le")
    return [spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)], starts, np.asarray(rows, np.int32)[row]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of stored rows, (block, row, title, content) in lower case, a part at a time.

    A part is a run of one block's rows, named by its first.
    """
    for batch in batches:
        blocks, rows, titles, contents = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(rows):
            end, letters = at, 0
            while end < len(rows) and blocks[end] == blocks[at] and end - at < PART_ROWS and letters < PART_LETTERS:
                letters += len(titles[end]) + len(contents[end])
                end += 1
            texts = [list(x) for x in zip(titles[at:end], contents[at:end], strict=True)]
            grams, starts, listed = _posted(rows[at:end], texts)
            ends = pa.array(np.append(starts, len(listed)), pa.int32())
            same = lambda v: pa.array(np.full(len(grams), v), pa.int32())  # noqa: B023, E731
            lists = pa.ListArray.from_arrays(ends, pa.array(listed, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [same(blocks[at]), same(rows[at]), pa.array(grams, pa.string()), lists], ["block", "part", "gram", "rows"]
            )
            at = end


def _shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


class TrigramIndex:
    """A corpus and the trigrams of its titles and contents, stored under a path."""

    def __init__(self, spark: SparkSession, path: str):
        columns = spark.read.parquet(f"{path}/columns").schema  # a corpus without rows has no files to tell them
        self.rows = spark.read.schema(columns.add("row", IntegerType()).add("block", IntegerType())).parquet(f"{path}/rows")
        self.lists = spark.read.schema(f"{LISTS}, shard int").parquet(f"{path}/lists")

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> TrigramIndex:
        """Store ``corpus`` by date and index it.

        Two moves: rows to their blocks, and the lists to the files of their trigrams. Trigrams
        are listed where a block's texts are read. Null texts have none.
        """
        spark = corpus.sparkSession
        path = path or work_path(spark, "trigrams")
        blocks = max(1, -(-corpus.count() // rows_per_block))
        dealt = corpus.repartitionByRange(blocks, *newest_first()).sortWithinPartitions(*newest_first())
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int")
        placed = dealt.withColumn("block", F.spark_partition_id()).withColumn("row", row)
        corpus.limit(0).write.parquet(f"{path}/columns")
        placed.write.partitionBy("block").parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        low = [F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "content")]
        lists = stored.select("block", "row", *low).mapInArrow(_lists, LISTS).withColumn("shard", _shard(F.col("gram")))
        # Folders by trigram, rows of a file by trigram: a look-up opens those of its trigrams.
        dealt = lists.hint("rebalance", "shard").sortWithinPartitions("shard", "gram", "block", "part")
        dealt.write.partitionBy("shard").parquet(f"{path}/lists")
        return cls(spark, path)

    def candidates(self, grams: list[str]) -> DataFrame:
        """(block, row) of the rows that hold all of ``grams``."""
        asked = F.col("shard").isin(*[_shard(F.lit(g)) for g in grams]) & F.col("gram").isin(grams)
        met = self.lists.where(asked).groupBy("block", "part").agg(F.collect_list("rows").alias("lists"))
        common = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
        return met.where(F.size("lists") == len(grams)).select("block", F.explode(common).alias("row"))

    def match(self, q: str, **filters) -> DataFrame:
        """All rows with ``q`` in title or content, in any order, with the corpus' columns."""
        grams = needed(q)
        rows = self.rows
        if grams:
            found = materialize(self.candidates(grams), "trigram-candidates")
            rows = rows.where(self._holding(self._blocks(found, MOST_LISTED_BLOCKS + 1))).join(found, ["block", "row"], "left_semi")
        return keyword_match(where_corpus(rows, **filters), q).drop("block", "row")

    @staticmethod
    def _blocks(found: DataFrame, most: int, after: int = -1) -> list[int]:
        """The first ``most`` blocks behind ``after`` with candidates."""
        behind = found.where(F.col("block") > after).select("block").distinct().orderBy("block").limit(most)
        return [r["block"] for r in behind.collect()]

    @staticmethod
    def _holding(blocks: list[int]) -> Column:
        """The folders to open: by name, or where these are many all from the first on."""
        return F.col("block").isin(blocks) if len(blocks) <= MOST_LISTED_BLOCKS else F.col("block") >= blocks[0]

    def search(self, q: str, limit: int = 10, **filters) -> DataFrame:
        """``keyword_search`` with the same rows: newest first, contents cut to snippets.

        Blocks with candidates are opened from the newest on, twice as many each time, until
        ``limit`` rows are found. Texts without a trigram (two letters, or wildcards between)
        are searched by the scan.
        """
        if not q:
            raise ValueError("q must not be empty")
        check_range("limit", limit, 1, 50)
        grams = needed(q)
        if not grams:
            return keyword_search(self.rows.drop("block", "row"), q, limit, **filters)
        found = materialize(self.candidates(grams), "trigram-candidates")
        hits: list[tuple[int, int]] = []
        after, opened = -1, FIRST_BLOCKS
        while len(hits) < limit:
            blocks = self._blocks(found, opened, after)
            if not blocks:
                break
            here = self._holding(blocks) & (F.col("block") <= blocks[-1])
            rows = self.rows.where(here).join(found.where(here), ["block", "row"], "left_semi")
            good = keyword_match(where_corpus(rows, **filters), q).select("block", "row").orderBy("block", "row")
            hits += [(r["block"], r["row"]) for r in good.limit(limit - len(hits)).collect()]
            after, opened = blocks[-1], 2 * opened
        names = self.rows.sparkSession.createDataFrame(hits, "block int, row int")
        rows = self.rows.where(F.col("block").isin(sorted({b for b, _ in hits})))
        rows = rows.join(F.broadcast(names), ["block", "row"], "left_semi")  # at most ``limit`` names
        return article_projection(rows.orderBy(*newest_first()).limit(limit), truncate=True)
