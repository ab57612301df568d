"""Exact top-k by inner product with a dual-tree search over a cover tree.

A cover tree over a bounded sample gives nodes; every vector, query or not, is filed under its
nearest leaf, and each leaf's covering radii are taken over all vectors filed there. Queries
first meet their own leaf, which gives every query group a worst kth score. Pairs of nodes are
then walked from the root; a pair is dropped with all below it if no vector of the one can
reach the worst kth score of the other's queries. The pairs left meet in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.session import materialize

K = 20
SCALE = 64
SAMPLE_ROWS = 4_096
LEAVES = 64
BLOCK_ROWS = 8_192
QUERY_CHUNK = 256


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component; vectors with null or non-finite ones are left out."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("bigint")).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; as doubles where those are exact, else as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Node:
    center: int
    children: list[Node] = field(default_factory=list)
    data_radius: float = -1.0
    query_radius: float = -1.0
    worst: float = np.inf  # over the node's queries, of their kth scores so far


@dataclass
class CoverTree:
    """Leaves at ``centers``; an inner node covers its children at half the scale of its parent."""

    centers: np.ndarray
    root: Node

    @staticmethod
    def over(sample: np.ndarray, leaves: int) -> CoverTree:
        """Centers by farthest-first order, whose distances shrink; a center hangs under the
        nearest one of the next larger scale, a scale being a power of two of the distance."""
        sample = np.unique(sample, axis=0).astype(np.float64)
        chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
        gaps = [np.inf]
        while len(chosen) < min(leaves, len(sample)):
            gaps.append(float(far.max()))
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
        centers = sample[chosen]
        level = [int(np.floor(np.log2(max(g, 1e-9)))) if np.isfinite(g) else 10**6 for g in gaps]
        top = [Node(i) for i in range(len(centers))]  # node that stands for a center at its own scale
        for i in range(1, len(centers)):
            above = [j for j in range(i) if level[j] > level[i]]
            parent = above[int(np.linalg.norm(centers[above] - centers[i], axis=1).argmin())]
            top[parent].children.append(top[i])
        for node in top:
            if node.children:
                node.children.append(Node(node.center))  # its own leaf
        return CoverTree(centers, top[0])

    def file(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest leaf of each row, and the distance."""
        squares = (rows.astype(np.float64) ** 2).sum(1)[:, None] + (self.centers**2).sum(1) - 2 * rows @ self.centers.T
        leaf = squares.argmin(1)
        return leaf, np.linalg.norm(rows - self.centers[leaf], axis=1)

    def spread(self, data: dict[int, float], queries: dict[int, float], worst: dict[int, float]) -> None:
        """Carry the leaves' radii and worst kth scores up to the root."""

        def fill(node: Node) -> None:
            if not node.children:
                node.data_radius, node.query_radius = data.get(node.center, -1.0), queries.get(node.center, -1.0)
                node.worst = worst.get(node.center, np.inf)
                return
            for child in node.children:
                fill(child)
                way = float(np.linalg.norm(self.centers[node.center] - self.centers[child.center]))
                node.worst = min(node.worst, child.worst)
                if child.data_radius >= 0:
                    node.data_radius = max(node.data_radius, way + child.data_radius)
                if child.query_radius >= 0:
                    node.query_radius = max(node.query_radius, way + child.query_radius)

        fill(self.root)

    def pairs(self) -> list[tuple[int, int]]:
        """(query leaf, data leaf) that may still hold a score of a query's k best."""
        out, stack = [], [(self.root, self.root)]
        norms = np.linalg.norm(self.centers, axis=1)
        while stack:
            a, b = stack.pop()
            if a.query_radius < 0 or b.data_radius < 0:
                continue
            bound = float(self.centers[a.center] @ self.centers[b.center]) + norms[a.center] * b.data_radius
            bound += norms[b.center] * a.query_radius + a.query_radius * b.data_radius
            if bound * (1 + 1e-9) + 1e-6 < a.worst:
                continue
            if not a.children and not b.children:
                out.append((a.center, b.center))
            elif a.children and (not b.children or a.query_radius >= b.data_radius):
                stack += [(child, b) for child in a.children]
            else:
                stack += [(a, child) for child in b.children]
        return out


def filed(rows: DataFrame, tree: CoverTree, width: int) -> DataFrame:
    """(vec_id, q, leaf, away): every row under its nearest leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, away = tree.file(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(away)], ["vec_id", "q", "leaf", "away"]
            )

    return rows.mapInArrow(run, "vec_id bigint, q array<bigint>, leaf int, away double")


def met(data: DataFrame, asked: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best of each block it is sent to.

    ``data`` holds (block, vec_id, q), a block being bounded; ``asked`` (block, vec_id, q,
    least), where scores under ``least`` are of no use. A task keeps one block and lets the
    queries sent there pass by.
    """
    sides = data.select("block", F.lit(0).alias("side"), "vec_id", "q", F.lit(None).cast("bigint").alias("least"))
    sides = sides.unionByName(asked.select("block", F.lit(1).alias("side"), "vec_id", "q", "least"))
    dealt = sides.repartition("block").sortWithinPartitions("block", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows = None, [], []
        for batch in batches:
            blocks, sides_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides_) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
                own = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                q = matrix(batch.column(3).slice(a, b - a), width)
                if sides_[a] == 0:
                    if blocks[a] != block:
                        block, ids, rows = blocks[a], [], []
                    ids.append(own)
                    rows.append(q)
                elif blocks[a] == block:
                    if len(ids) > 1:
                        ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    least = batch.column(4).slice(a, b - a).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    for c in range(0, b - a, QUERY_CHUNK):
                        part = slice(c, c + QUERY_CHUNK)
                        yield from _best(ids[0], rows[0], own[part], q[part], least[part], k)

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(ids, rows, query_ids, queries, least, k) -> Iterator[pa.RecordBatch]:
    """``ids`` ascend, so of equal scores the first are those of smaller ids."""
    scores, out = inner(queries, rows), []
    for i, query in enumerate(query_ids):
        use = np.flatnonzero((scores[i] >= least[i]) & (ids != query))
        if len(use) > k:
            own = scores[i][use]
            cut = np.partition(own, len(own) - k)[len(own) - k]
            above, level = use[own > cut], use[own == cut]
            use = np.concatenate([above, level[: k - len(above)]])
        out.append(np.stack([np.full(len(use), query), ids[use], scores[i][use]]))
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    if found.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, leaves: int = LEAVES,
    sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner products for each query.

    Both tables hold (vec_id, embedding). Columns query_id, rank, vec_id, score; ties go to the
    smaller vec_id. A row with the query's vec_id is its own and no candidate. The centers are
    fitted on at most ``sample_rows`` rows, chosen by a hash of the id; all rows are filed.

    Null vectors, and those with null or non-finite components, take no part, nor do null
    ids. Vectors of unequal length: the shorter is filled with zeros; an empty one scores 0.
    Rows that repeat a vec_id: candidates each; as a query, the least of the vectors. Fewer
    than ``k`` candidates: all of them. Empty input: no rows. Other columns are not looked at.
    """
    rows = materialize(quantized(vectors, scale), "topk-rows")
    size = rows.agg(F.max(F.size("q")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    width, n = size["w"] or 0, size["n"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("q").collect()
    points = np.zeros((max(len(sample), 1), width), np.int64)
    for i, row in enumerate(sample):
        points[i, : len(row["q"])] = row["q"]
    tree = CoverTree.over(points, leaves)

    data = materialize(filed(rows, tree, width), "topk-filed")
    asked = quantized(queries, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = materialize(filed(asked, tree, width), "topk-queries")
    held = {r["leaf"]: r for r in data.groupBy("leaf").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    reach = {r["leaf"]: r["r"] for r in asked.groupBy("leaf").agg(F.max("away").alias("r")).collect()}
    blocks = {leaf: -(-r["n"] // block_rows) for leaf, r in held.items()}

    by_leaf = F.create_map(*[F.lit(x) for item in {-1: 1, **blocks}.items() for x in item])
    place = lambda leaf, part: (leaf.cast("bigint") * F.lit(2**32) + part).alias("block")
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce(by_leaf[F.col("leaf")], F.lit(1)))
    data = data.select(place(F.col("leaf"), part), "vec_id", "q")

    def sent(queries_: DataFrame, to: dict[int, list[int]]) -> DataFrame:
        """Queries to all blocks of the leaves their own leaf is paired with; ``to`` has as many entries as leaves."""
        listed = [(leaf, [d for d in others if d in blocks]) for leaf, others in to.items()]
        table = data.sparkSession.createDataFrame(listed, "leaf int, others array<int>")
        paired = queries_.join(F.broadcast(table), "leaf").select(F.explode("others").alias("other"), "vec_id", "q", "least")
        parts = F.explode(F.sequence(F.lit(0), by_leaf[F.col("other")] - 1)).alias("part")
        return paired.select("other", parts, "vec_id", "q", "least").select(
            place(F.col("other"), F.col("part")), "vec_id", "q", "least"
        )

    first = asked.withColumn("least", F.lit(None).cast("bigint"))
    near = materialize(met(data, sent(first, {leaf: [leaf] for leaf in reach}), width, k), "topk-near")
    floor = ranked(near, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("c"))
    floor = floor.where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), "least")
    second = materialize(asked.join(floor, "vec_id", "left").select("vec_id", "q", "leaf", "least"), "topk-floors")
    group = second.groupBy("leaf").agg(F.min(F.coalesce("least", F.lit(-(2**63)))).alias("w")).collect()
    tree.spread({leaf: r["r"] for leaf, r in held.items()}, reach, {r["leaf"]: float(r["w"]) for r in group})
    to: dict[int, list[int]] = {}
    for a, b in tree.pairs():
        if a != b:
            to.setdefault(a, []).append(b)
    far = met(data, sent(second, to), width, k)
    return ranked(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
