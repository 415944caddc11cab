"""Vectorised window hashing over many documents laid end to end.

All routines work on one shard of documents at a time: the symbols (bytes or
word hashes) of its documents are concatenated, and windows that would cross a
document's end are masked out.  Hashes are polynomial modulo 2**64, read from
prefix sums, and finished with an avalanche mix.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers of the polynomial hashes (any odd 64-bit values serve).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values; ``seed`` selects one of many functions."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


class Prefix:
    """Prefix sums of ``sum(symbol[i] * base**i)``, giving any range's hash."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        with np.errstate(over="ignore"):
            powers = np.full(n, base, np.uint64)
            inverse = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
            if n:
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(powers * symbols, out=self.sums[1:])
        self.inverse = inverse

    def every(self, k: int) -> np.ndarray:
        """Hash of each range of ``k`` symbols."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])

    def at(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` symbols at each of ``starts``."""
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + k] - self.sums[starts]) * self.inverse[starts])


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` (np.minimum or np.maximum) over each range of ``w`` values."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = f(x[:-span], x[span:])
        span *= 2
    if span < w:
        rest = w - span
        x = f(x[: len(x) - rest], x[rest:])
    return x


def valid_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Mask over all symbols: a window of ``window`` fits its document here."""
    n = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.arange(n) + window <= ends


def window_minima(prefix: Prefix, gram: int, window: int) -> np.ndarray:
    """For each window of ``window`` symbols its least ``gram``-hash.

    Equal windows have equal minima, and a passage of at least ``window``
    symbols yields the same minima wherever it stands.
    """
    return sliding(prefix.every(gram), window - gram + 1, np.minimum)


def runs(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of maximal runs of one value where ``mask`` holds."""
    if not len(values):
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.flatnonzero((values[1:] != values[:-1]) | (mask[1:] != mask[:-1])) + 1
    starts = np.concatenate(([0], cut))
    ends = np.concatenate((cut, [len(values)]))
    keep = mask[starts]
    return starts[keep], ends[keep]


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the positions covered by windows of ``width`` at ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0
