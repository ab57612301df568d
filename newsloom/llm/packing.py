"""Best-fit packing of documents into sequences, by bin completion.

Only the counts of piece lengths matter to a packing, and there are at most as many lengths
as a sequence has tokens. The driver packs that histogram by branch and bound; each filling
it decides on is used as often as the counts allow. Rows then find their sequence by their
number among the pieces of their length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_batches, positions
from newsloom.llm.tokens import encoder
from newsloom.session import materialize

CAPACITY = 1024
END_ID = 2
MOST_NODES = 5_000


@dataclass(frozen=True)
class Filling:
    """A sequence's lengths, longest first, and how many sequences are filled so."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences by waste: with lengths over ``capacity - k`` alone, what is at least
    ``k`` has to go beside the large ones or into sequences of its own; the best over all k."""
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    number = np.concatenate([[0], np.cumsum(counts)])  # of pieces shorter than the index
    total = np.concatenate([[0], np.cumsum(counts * np.arange(len(counts)))])
    n_over_half = number[-1] - number[half + 1]
    room = (number[capacity - k + 1] - number[half + 1]) * capacity - (total[capacity - k + 1] - total[half + 1])
    more = np.maximum(0, -(-(total[half + 1] - total[k] - room) // capacity))
    return max(-(-int(total[-1]) // capacity), int((n_over_half + more).max()))


def completions(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room``, least waste first; None for each dead end on the way.

    A filling is dominated if some of its pieces, or none, can give place to one longer piece
    that is left over, or several to one of their length. Sets of lengths are bits of integers:
    ``reach[k]`` has the sums of pieces of the k shortest lengths, so only sums that can be
    made are tried, and the first filling is met without a dead end.
    """
    lengths = [int(n) for n in np.flatnonzero(counts[: room + 1]) if n]
    if not lengths:
        yield ()
        return
    if counts[room]:
        yield (room,)
        return
    there, within = {n: int(counts[n]) for n in lengths}, (1 << (room + 1)) - 1
    reach = [1]
    for n in lengths:
        sums, left, step = reach[-1], min(there[n], room // n), 1
        while left:
            step = min(step, left)
            sums |= (sums << n * step) & within
            left, step = left - step, 2 * step
        reach.append(sums)
    available = sum(1 << n for n in lengths)

    def spread(sums: int, waste: int) -> int:
        """The numbers that are 1 to ``waste`` over one of ``sums``."""
        done, out = 1, sums << 1
        while done < waste:
            step = min(done, waste - done)
            out, done = out | out << step, done + step
        return out if waste else 0

    for fill in range(room, -1, -1):
        if not reach[-1] >> fill & 1:
            continue
        waste = room - fill
        # (pieces so far, still to fill, lengths to choose from, sums of one piece, of more, lengths left over)
        stack = [((), fill, len(lengths), 0, 0, available)]
        while stack:
            chosen, rest, top, one, more, over = stack.pop()
            if not rest:
                if spread(1, waste) & over:
                    yield None
                else:
                    yield chosen
                continue
            tried = []
            for k in range(top):
                n = lengths[k]
                used = chosen.count(n) if k == top - 1 else 0
                if n > rest or used == there[n] or not _made(reach, lengths, there, k, rest - n, used + 1):
                    continue
                several = (one | more) << n
                left_over = over & ~(1 << n) if used + 1 == there[n] else over
                if several & left_over or spread(several | 1 << n, waste) & left_over:
                    tried.append(None)
                    continue
                tried.append((chosen + (n,), rest - n, k + 1, one | 1 << n, more | several, left_over))
            stack += [t for t in tried if t]
            for _ in range(tried.count(None)):
                yield None


def _made(reach: list[int], lengths: list[int], there: dict[int, int], k: int, rest: int, used: int) -> bool:
    """Whether ``rest`` is a sum of pieces up to the k-th length, of which ``used`` are taken."""
    n = lengths[k]
    return any(reach[k] >> (rest - n * c) & 1 for c in range(min(there[n] - used, rest // n) + 1))


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY, most_nodes: int = MOST_NODES) -> list[Filling]:
    """Fillings for all pieces, ``counts[n]`` of length n.

    Depth first: the longest piece left gets each of its undominated fillings, best first,
    used as often as the counts allow, then half as often, down to once. The first descent is
    the incumbent. A branch is cut once the sequences used and the lower bound for what is
    left reach it, or if the same pieces were left before after no more sequences. At the
    bound for the whole, or after ``most_nodes`` nodes and dead ends, the incumbent is the answer.
    """
    counts = counts.astype(np.int64)
    goal = lower_bound(counts, capacity)
    best, best_bins, nodes, seen = None, None, 0, {}

    def branches(left: np.ndarray, skip: int) -> Iterator[tuple[Filling, np.ndarray] | None]:
        longest = int(np.flatnonzero(left)[-1])
        less = left.copy()
        less[longest] -= 1
        for more in completions(less, capacity - longest):
            if more is None:
                yield None
                continue
            filling = (longest, *sorted(more, reverse=True))
            used = np.bincount(filling, minlength=len(counts))
            times = int((left[used > 0] // used[used > 0]).min())
            while times:
                if skip:
                    skip -= 1
                else:
                    yield Filling(filling, times), left - used * times
                times //= 2

    # a node's branches are made again when the search comes back to it, so that few are held at a time
    stack = [[counts, None, 0, None]]
    while stack:
        node = stack[-1]
        left, path, bins, made = node
        if made is None:
            nodes += 1
            if not left[1:].any():
                if best_bins is None or bins < best_bins:
                    best, best_bins = path, bins
                if best_bins <= goal:
                    break
                stack.pop()
                continue
            key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
            if seen.get(key, bins + 1) <= bins or best_bins is not None and bins + lower_bound(left, capacity) >= best_bins:
                stack.pop()
                if best_bins is not None and nodes > most_nodes:
                    break
                continue
            seen[key] = bins
            if best_bins is not None and nodes > most_nodes:
                break
            filling, then = next(b for b in branches(left, 0) if b)
            node[3] = ()
            stack.append([then, (filling, path), bins + filling.times, None])
            continue
        if bins + lower_bound(left, capacity) >= best_bins:
            stack.pop()
            continue
        if made == ():
            made = node[3] = branches(left, 1)
        branch = next(made, ())
        if branch:
            stack.append([branch[1], (branch[0], path), bins + branch[0].times, None])
        elif branch is None:
            nodes += 1
            if nodes > most_nodes:
                break
        else:
            stack.pop()
    out = []
    while best is not None:
        filling, best = best
        out.append(filling)
    return out[::-1]


def places(fillings: list[Filling], capacity: int) -> dict[str, np.ndarray]:
    """Per length, sorted: from which number on its pieces go to which filling, and where there."""
    rows, given, base = [], np.zeros(capacity + 1, np.int64), 0
    for filling in fillings:
        offset = 0
        for length in dict.fromkeys(filling.lengths):
            copies = filling.lengths.count(length)
            rows.append((length, given[length], base, copies, offset))
            given[length] += copies * filling.times
            offset += copies * length
        base += filling.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "copies", "offset"), table.T.copy()))


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of each document's ids and an end id.

    Documents of more than ``capacity`` ids are cut into pieces of that many; what is over is
    the first piece.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            who, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    who.append(row)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            columns = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, most_nodes: int = MOST_NODES,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """Place every document's pieces in sequences of at most ``capacity`` tokens.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: one piece, the end id. Null doc_id: kept. Repeated rows: pieces of
    each. Pieces of one length are interchangeable, so ties need no order. Empty input: no
    rows. Other columns are not looked at. Texts of any length are cut whole.
    """
    pieces = materialize(tokenized(docs, path, capacity, end_id), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    where = places(pack_counts(counts, capacity, most_nodes), capacity)
    mix = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), 4)
    numbered = positions(pieces.withColumn("_mix", mix), "length", "_mix", "_number", rows_per_block)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = where["length"] << 44 | where["first"]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            index, copies = number - where["first"][at], where["copies"][at]
            sequence = where["base"][at] + index // copies
            offset = where["offset"][at] + index % copies * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*fields, "_number").mapInArrow(place, schema)
