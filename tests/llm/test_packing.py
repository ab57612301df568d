import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing
from newsloom.llm.tokens import Encoder
from tests.llm.frames import frame, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", [
    "", " ", "  a  b ", "a\n b", "x<|endoftext|>y <|endoftext|>", "don't  stop\t\t now 　 z", "a \x1c b\x85 c",
    "é" * 3000, "😀 👍🏽 a", "it's we'll I'D", "1234 56.7", "\r\n\r\n  x", "a " * 10, "<|endoftext|>", "a  b ​ c",
])
def test_ids_are_those_of_tokenizers(tokenizer, text):
    ids = np.frombuffer(Encoder(PATH).encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def check(got, rows, tokenizer, capacity):
    pieces = Counter()
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert pieces == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_offsets(spark, tokenizer):
    rows = odd_rows() + [(700 + i, prose(i, 1 + i % 50)) for i in range(150)]
    for capacity in (64, 1024):
        got = packing.pack_documents(frame(spark, rows), PATH, capacity, rows_per_block=9).collect()
        used = check(got, rows, tokenizer, capacity)
        total = sum(r["length"] for r in got)
        assert used <= -(-total // capacity) * 1.05 + 1


def test_empty(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


def fewest(lengths, capacity):
    """By trying all ways, for a handful of pieces."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_small_packings_are_near_the_fewest(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 21, 10).tolist()
    counts = np.bincount(lengths, minlength=21)
    fillings = packing.pack_counts(counts, 20)
    used = np.zeros(21, int)
    for f in fillings:
        assert sum(f.lengths) <= 20
        for n in f.lengths:
            used[n] += f.times
    assert (used == counts).all()
    bins = sum(f.times for f in fillings)
    best = fewest(lengths, 20)
    assert packing.lower_bound(counts, 20) <= best <= bins <= best + 1


def test_large_counts_take_few_fillings():
    counts = np.random.default_rng(5).integers(0, 10**9, 1025)
    counts[0] = 0
    fillings = packing.pack_counts(counts, most_nodes=200)
    assert len(fillings) < 6000
    assert sum(f.times for f in fillings) <= 1.01 * packing.lower_bound(counts, 1024)


def bins_of(lengths, capacity):
    return sum(f.times for f in packing.pack_counts(np.bincount(lengths, minlength=capacity + 1), capacity))


def test_wasteful_fillings_are_tried():
    assert bins_of([520] * 600 + [300] * 1800 + [250] * 1200, 1024) == 1200


@pytest.mark.parametrize("seed", range(30, 60))
def test_small_packings_are_the_fewest(seed):
    lengths = np.random.default_rng(seed).integers(2, 14, 11).tolist()
    assert bins_of(lengths, 20) == fewest(lengths, 20)
