"""Wavelet matrix over a short alphabet, for many rank and select queries at once."""

from __future__ import annotations

import numpy as np

_WORD = 64


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        packed = np.zeros((self.n // _WORD + 1) * 8, np.uint8)
        octets = np.packbits(bits, bitorder="little")
        packed[: len(octets)] = octets
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols below ``2 ** levels``; each level keeps one bit of every symbol, zeros moved before ones."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.n, self.depth = len(symbols), levels
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(levels):
            bits = ((symbols >> (levels - 1 - level)) & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(self.n - int(self.levels[-1].before[-1]))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` symbols, for an array of places."""
        first, last = np.zeros_like(at), at
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(last)
            begin = bits.rank(first)
            if (symbol >> (self.depth - 1 - level)) & 1:
                first, last = zeros + begin, zeros + ones
            else:
                first, last = first - begin, last - ones
        return last - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Ranks of several symbols, added up."""
        return sum(self.rank(s, at) for s in symbols)

    def select(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest place in ``(low, high]`` before which ``k`` of the symbols stand, by bisection on ranks.

        ``k`` counts from the start of the sequence; ``high`` must have that many before it.
        """
        low, high = low.copy(), high.copy()
        while (high - low > 1).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= k
            high = np.where(enough, middle, high)
            low = np.where(enough, low, middle)
        return high
