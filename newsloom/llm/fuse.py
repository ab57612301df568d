"""Binary fuse filters (3-wise, 8-bit) over 64-bit keys, built and asked with numpy.

Three places per key in adjoining segments; construction removes, round by round, all keys
that are alone in some place, and fills the table in reverse. About 9 bits a key, and one
key in 256 that was not put in is reported as present.
"""

from __future__ import annotations

import math

import numpy as np

SEEDS = 64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of starting segments."""
    n = max(n, 2)
    length = min(2 ** int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 2**18)
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(room / length) - 2)


def _places(h: np.ndarray, length: int, starts: int) -> np.ndarray:
    span, mask = np.uint64(length * starts), np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, starting segments, table) for any keys, repeats included."""
    keys = np.unique(keys.astype(np.uint64))
    length, starts = _shape(len(keys))
    slots = length * (starts + 2)
    for seed in range(SEEDS):
        h = _mixed(keys, seed)
        at = _places(h, length, starts)
        count = np.bincount(at.ravel(), minlength=slots)
        names = np.zeros(slots, dtype=np.int64)  # sum of the numbers of the keys in a place
        np.add.at(names, at.ravel(), np.repeat(np.arange(len(keys)), 3))
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            who, first = np.unique(names[alone], return_index=True)
            rounds.append((who, alone[first]))
            left -= len(who)
            touched = at[who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(names, touched, np.repeat(who, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            continue
        table, prints = np.zeros(slots, dtype=np.uint8), _prints(h)
        for who, slot in reversed(rounds):
            table[slot] = 0
            table[slot] = prints[who] ^ np.bitwise_xor.reduce(table[at[who]], axis=1)
        return seed, length, starts, table.tobytes()
    raise RuntimeError("no seed gives a binary fuse filter")


def contains(keys: np.ndarray, seed: int, length: int, starts: int, table: bytes) -> np.ndarray:
    h = _mixed(keys.astype(np.uint64), seed)
    cells = np.frombuffer(table, dtype=np.uint8)[_places(h, length, starts)]
    return np.bitwise_xor.reduce(cells, axis=1) == _prints(h)
