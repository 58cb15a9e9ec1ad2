"""A wavelet matrix over small symbols in numpy: ranks and places of any class, many at a time."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletMatrix:
    """Symbols below 2^levels; every level holds one bit of each, zeros before ones on the next."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.size, self.levels = len(symbols), levels
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at`` symbols."""
        low, high = np.zeros_like(at), at
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = zeros + bits.ones(low), zeros + bits.ones(high)
            else:
                low, high = low - bits.ones(low), high - bits.ones(high)
        return high - low

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How often any of ``symbols`` is among the first ``at``."""
        total = np.zeros(len(at), np.int64)
        for symbol in symbols:
            total += self.rank(symbol, at)
        return total

    def select(self, symbols: tuple[int, ...], which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place in [low, high] with at least ``which`` of ``symbols`` before it (``high``
        where there are fewer), by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= which
            high = np.where(enough, middle, high)
            low = np.where(enough | (low >= high), low, middle + 1)
        return low
