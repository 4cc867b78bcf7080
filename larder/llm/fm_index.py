"""An FM-index over sequences of words: suffix order, wavelet tree and sampled positions, in numpy.

The text is an array of symbols: words are 1, 2, ..., and each sequence ends in a 0. The zeros count as
different symbols, ordered by place, so no suffix is compared beyond the end of its sequence. All
searches go through many patterns or rows at once, one array operation for each level of the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Three numbers below this fit into 63 bits: suffixes are sorted as single integers.
BITS = 21
MOST = 1 << BITS
#: Every so manyth position of the text is kept.
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of a text's suffixes in their order: first by a few symbols, then by twice as many each round.

    Only suffixes that are still equal to others are sorted on.
    """
    n = len(text)
    if n > MOST:
        raise ValueError(f"a text of {n} symbols; {MOST} at most")
    width = max(1, int(text.max()).bit_length())
    taken = min(n, (63 - BITS) // width)
    at = np.arange(n, dtype=np.int64)
    key, within = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(taken):
        symbol = np.zeros(n, np.int64)
        symbol[: n - j] = text[j:]
        key = (key << width) | np.where(within, symbol, 0)
        within &= symbol > 0
    key = np.sort((key << BITS) | at)
    order = key & (MOST - 1)
    key >>= BITS
    head = np.ones(n, bool)
    head[1:] = (key[1:] != key[:-1]) | ~within[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    alone = head & np.append(head[1:], True)
    open_ = np.flatnonzero(~alone)
    h = taken
    while len(open_):
        place = order[open_]
        key = np.sort((((rank[place] << BITS) | rank[place + h]) << BITS) | place)
        place = key & (MOST - 1)
        key >>= BITS
        head = np.ones(len(open_), bool)
        head[1:] = key[1:] != key[:-1]
        order[open_] = place
        rank[place] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~(head & np.append(head[1:], True))]
        h *= 2
    return order


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit numbers, with at least one zero behind them."""
    out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    b = np.packbits(bits, bitorder="little")
    out[: len(b)] = b
    return out.view("<u8")


class Bits:
    """A bit vector with ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """A wavelet tree in its matrix layout: a level holds one bit of every symbol, those with a 0 above come before those with a 1."""

    def __init__(self, levels: list[np.ndarray], n: int) -> None:
        self.n, self.levels = n, [Bits(w) for w in levels]
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]

    @staticmethod
    def made(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
        levels = []
        for d in range(depth - 1, -1, -1):
            one = (symbols >> d) & 1 == 1
            levels.append(packed(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        return levels

    def _bit(self, level: int, symbol: np.ndarray) -> np.ndarray:
        return (symbol >> (len(self.levels) - 1 - level)) & 1 == 1

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i ends up on the way of a symbol: the symbol's start at the bottom plus its occurrences before i."""
        for level, bits in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(self._bit(level, symbol), self.zeros[level] + ones, i - ones)
        return i

    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and where that place ends up."""
        symbol = np.zeros(len(i), np.int64)
        for level, bits in enumerate(self.levels):
            one, ones = bits.at(i), bits.rank(i)
            symbol = (symbol << 1) | one
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return symbol, i


@dataclass
class Index:
    """What an index is stored as: bits of the tree's levels, rows with a kept place, those places, counts of symbols."""

    n: int
    tree: np.ndarray
    marks: np.ndarray
    samples: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray) -> Index:
        order = suffix_order(text)
        before = text[order - 1]
        kept = (order % SAMPLE == 0) | (before == 0)
        counts = np.bincount(text)
        depth = max(1, (len(counts) - 1).bit_length())
        return cls(len(text), np.concatenate(WaveletTree.made(before, depth)), packed(kept), order[kept].astype("<i4"), counts.astype("<i4"))


class Searcher:
    """Searches in a stored index."""

    def __init__(self, index: Index) -> None:
        self.symbols = len(index.counts)
        depth = max(1, (self.symbols - 1).bit_length())
        self.tree = WaveletTree(list(index.tree.reshape(depth, -1)), index.n)
        self.marks, self.samples = Bits(index.marks), index.samples
        #: First row of each symbol, and what leads from the tree's bottom to the rows.
        self.first = np.concatenate([[0], np.cumsum(index.counts, dtype=np.int64)])
        every = np.arange(self.symbols)
        self.shift = self.first[:-1] - self.tree.descend(every, np.zeros(self.symbols, np.int64))

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of suffixes that begin with each pattern: its symbols at the right end of a row of the array, 0 left
        of them, -1 for a symbol that the text doesn't have. Backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.tree.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            hi[symbol < 0] = 0
            go = np.flatnonzero((symbol > 0) & (lo < hi))
            if not len(go):
                continue
            s = symbol[go]
            lo[go] = self.shift[s] + self.tree.descend(s, lo[go])
            hi[go] = self.shift[s] + self.tree.descend(s, hi[go])
        return lo, np.maximum(lo, hi)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, walked back to a kept place."""
        out, rows, left = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(left):
            kept = self.marks.at(rows)
            out[left[kept]] = self.samples[self.marks.rank(rows[kept])] + steps
            left, rows = left[~kept], rows[~kept]
            if len(left):
                symbol, rows = self.tree.follow(rows)
                rows = self.shift[symbol] + rows
            steps += 1
        return out
