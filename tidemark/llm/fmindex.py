"""A compressed FM-index over word numbers: wavelet tree of the Burrows-Wheeler transform, vectorised backward search."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class BitVector:
    """Bits in 64-bit words with a running count per word: rank in constant time, 1.5 bits per bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK + BLOCK, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Balanced wavelet tree stored level by level (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[tuple[BitVector, int]] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.rows.append((BitVector(bit), zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``low`` and before ``high``."""
        begin = np.zeros(len(symbol), np.int64)
        for i, (bits, zeros) in enumerate(self.rows):
            one = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            ranks = [bits.ones(x) for x in (begin, low, high)]
            begin, low, high = (np.where(one, zeros + r, x - r) for x, r in zip((begin, low, high), ranks))
        return low - begin, high - begin


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their first ``depth`` symbols or more (ties by position)."""
    rank, width = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        step = np.empty(len(text), bool)
        follow = np.zeros(len(text), np.int64)
        follow[: len(text) - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        step[0], step[1:] = False, key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if width >= depth or rank[order[-1]] == len(text) - 1:
            return order


class FMIndex:
    """Index of a text of numbers from 0 to sigma - 1, for patterns of at most ``depth`` symbols.

    The text is cyclic, so patterns must not reach over a separator that the text ends with.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(np.concatenate([text, text[:0]]), 2 * depth)
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(text[self.order - 1], sigma)
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front (one step of backward search)."""
        low, high = self.tree.rank(symbol, low, high)
        return self.first[symbol] + low, self.first[symbol] + high

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched symbols, interval) of text[start : start + length], searched backward from its last symbol.

        A search ends where its interval is empty or holds a single position, as nothing else can match then.
        """
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        matched = np.zeros(len(starts), np.int64)
        active = np.arange(len(starts))
        for step in range(length):
            lo, hi = self.extend(text[starts[active] + length - 1 - step], low[active], high[active])
            found = hi > lo
            low[active], high[active] = lo, hi
            matched[active[found]] = step + 1
            active = active[hi - lo > 1]
            if not len(active):
                break
        return matched, low, high
