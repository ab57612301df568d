"""Hashes of words and of runs of words, for a whole text at once with numpy.

A word's hash is a polynomial in its bytes, taken from running sums; a run's hash is a
polynomial in its words' hashes, built by doubling. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np

_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Stretches without white space (space and 0x09 to 0x0D), in order."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data) - 1), out=sums[1:])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    own = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mixed(own + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int, factor: int = FACTORS[0]) -> np.ndarray:
    """Hash of every run of ``length`` words, by where it starts."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    power, step, times = words, 1, factor
    while True:
        if length & step:
            out = out * np.uint64(times) + power[done : done + n]
            done += step
        if done == length:
            return mixed(out)
        power = power[:-step] * np.uint64(times) + power[step:]
        step, times = 2 * step, times * times % 2**64


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values lies, the first of equal ones.

    Values are compared by their upper 32 bits.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    return (low & np.uint64(2**32 - 1)).astype(np.int64)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to before each end."""
    factor = FACTORS[1]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(factor, len(words))[1:], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _powers(pow(factor, -1, 2**64), len(words))[starts]
    return mixed(own + (ends - starts).astype(np.uint64))
