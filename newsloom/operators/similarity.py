"""Exact cosine top-k for one query vector or many.

Vectors stream through Arrow batches into one matrix product per batch; a task emits at
most k rows per query. Nothing else of the vector table moves.

Order: similarity rounded to ten digits, descending, then ``content_id``. The rounding
keeps copies of one vector tied, whatever order their products were summed in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TIE_DIGITS = 10
MAX_SHIPPED_CELLS = 2_000_000
PRODUCT_CELLS = 4_000_000
HIT_SCHEMA = "query_id string, content_id string, url string, title string, similarity double"
HIT_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
_HIT_NAMES = ["query_id", "content_id", "url", "title", "similarity"]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN, as its cosine is undefined."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row positions, matrix) of the rows that hold a vector of the right length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if len(rows) != len(column):
        column = column.take(pa.array(rows))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat.reshape(len(rows), dim)


def _task_topk(query_ids: list[str], queries: np.ndarray, k: int):
    """Arrow batches in, the task's k best rows per query out.

    Rows are scored in slices whose product stays small. Once a query has k rows, only
    rows that reach its k-th similarity are looked at again.
    """
    dim, asked = queries.shape[1], len(query_ids)
    step = max(1, PRODUCT_CELLS // max(1, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(asked, -np.inf)
        best: list[list[tuple]] = [[] for _ in range(asked)]
        for batch in batches:
            rows, matrix = _dense(batch.column("embedding"), dim)
            units = unit_rows(matrix)
            ids, urls, titles = (batch.column(n) for n in ("content_id", "url", "title"))
            for low in range(0, len(rows), step):
                sims = units[low : low + step] @ queries.T
                keys = np.round(sims, TIE_DIGITS)
                # NaN reaches no floor, so rows without a direction drop out here.
                for q in np.flatnonzero((keys >= floor).any(axis=0)):
                    for n in _leading(keys[:, q], floor[q], k, ids, rows[low : low + step]):
                        at = int(rows[low + n])
                        best[q].append((-keys[n, q], ids[at].as_py(), sims[n, q], urls[at].as_py(), titles[at].as_py()))
                    best[q].sort(key=lambda hit: hit[:2])
                    del best[q][k:]
                    if len(best[q]) == k:
                        floor[q] = -best[q][-1][0]
        hits = [(query_ids[q], h[1], h[3], h[4], h[2]) for q in range(asked) for h in best[q]]
        for low in range(0, len(hits), 10_000):
            columns = zip(*hits[low : low + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, HIT_TYPES)], names=_HIT_NAMES
            )

    return run


def _leading(keys: np.ndarray, floor: float, k: int, ids: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Positions of at most k rows at or above the floor, by similarity and then id."""
    found = np.flatnonzero(keys >= floor)
    if len(found) > k:
        named = pa.table({"key": keys[found], "id": ids.take(pa.array(rows[found]))})
        order = [("key", "descending"), ("id", "ascending")]
        found = found[pc.select_k_unstable(named, k, sort_keys=order).to_numpy()]
    return found


def query_width(queries: DataFrame) -> int:
    """The one length of the query vectors; 0 without any."""
    sizes = queries.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if sizes["low"] is not None and sizes["low"] != sizes["high"]:
        raise ValueError(f"query vectors have from {sizes['low']} to {sizes['high']} numbers")
    return sizes["high"] or 0


def misfits(vectors: DataFrame, dim: int) -> DataFrame:
    """(width, vectors): how many vectors have another length than ``dim``; null for no vector."""
    width = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return vectors.groupBy(width.alias("width")).agg(F.count("*").alias("vectors")).where(~F.col("width").eqNullSafe(F.lit(dim)))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' candidates per query, with their rank."""
    order = W.partitionBy("query_id").orderBy(F.round("similarity", TIE_DIGITS).desc(), F.asc("content_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_similarity(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Every vector's cosine to one query, row by row; NaN where lengths differ."""
    matrix = unit_rows(np.asarray([query], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _dense(batch.column("embedding"), matrix.shape[1])
            sims = np.full(batch.num_rows, np.nan)
            sims[rows] = unit_rows(found) @ matrix[0]
            kept = [batch.column(n) for n in ("content_id", "url", "title")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sims)], names=_HIT_NAMES[1:])

    narrow = vectors.select("content_id", "url", "title", "embedding")
    return narrow.mapInArrow(run, HIT_SCHEMA.removeprefix("query_id string, "))


def cosine_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to one query vector, best first."""
    matrix = unit_rows(np.asarray([query], dtype=np.float64))
    narrow = vectors.select("content_id", "url", "title", "embedding")
    hits = narrow.mapInArrow(_task_topk(["q"], matrix, k), HIT_SCHEMA)
    order = [F.round("similarity", TIE_DIGITS).desc(), F.asc("content_id")]
    return hits.drop("query_id").orderBy(*order).limit(k)


def cosine_topk_batch(
    vectors: DataFrame, queries: DataFrame, k: int, dim: int | None = None,
    max_cells: int = MAX_SHIPPED_CELLS, block_rows: int = 20_000, block_queries: int = 2_000,
) -> DataFrame:
    """The k nearest vectors of every query (``query_id``, ``embedding``).

    The width is that of the queries, which must agree; ``misfits`` counts the vectors that
    have another one and so no similarity.

    A query set of at most ``max_cells`` numbers is shipped to the tasks; a larger one
    goes through the blocked form, in which neither side is ever held whole.
    """
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    dim = query_width(queries) if dim is None else dim
    if not dim:
        return _ranked(queries.sparkSession.createDataFrame([], HIT_SCHEMA), k)
    limit = max(1, max_cells // dim)
    head = queries.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        rows, matrix = _dense(head.column("embedding"), dim)
        ids = head.column("query_id").take(pa.array(rows)).to_pylist()
        narrow = vectors.select("content_id", "url", "title", "embedding")
        hits = narrow.mapInArrow(_task_topk(ids, unit_rows(matrix), k), HIT_SCHEMA)
        return _ranked(hits, k)
    return _ranked(_blocked_hits(vectors, queries, k, dim, block_rows, block_queries), k)


def _blocked_hits(
    vectors: DataFrame, queries: DataFrame, k: int, dim: int, block_rows: int, block_queries: int
) -> DataFrame:
    """Block-matrix form: vector blocks meet query blocks, each pair in its own bounded group.

    Blocks are hashes of unique ids, so no block outgrows its expected size.
    """
    v_blocks = max(1, -(-vectors.count() // block_rows))
    q_blocks = max(1, -(-queries.count() // block_queries))

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))

    v_side = vectors.select("content_id", "url", "title", "embedding").select(
        "*", F.pmod(F.xxhash64("content_id"), F.lit(v_blocks)).alias("vb"), every(q_blocks).alias("qb")
    )
    q_side = queries.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"), every(v_blocks).alias("vb")
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, matrix = _dense(right.column("embedding"), dim)
        ids = right.column("query_id").take(pa.array(rows)).to_pylist()
        parts = list(_task_topk(ids, unit_rows(matrix), k)(iter(left.combine_chunks().to_batches())))
        schema = pa.schema(list(zip(_HIT_NAMES, HIT_TYPES)))
        return pa.Table.from_batches(parts, schema)

    grouped = v_side.groupBy("vb", "qb").cogroup(q_side.groupBy("vb", "qb"))
    return grouped.applyInArrow(meet, HIT_SCHEMA)
