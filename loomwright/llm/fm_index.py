"""A compressed FM-index over word ids: a wavelet matrix of the Burrows-Wheeler transform.

Searches run for many patterns at once: all arrays hold one entry for each pattern."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, dtype=bool)), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        for d in range(self.depth - 1, -1, -1):
            bit = (symbols >> d & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before at; first is descend(symbol, 0), which depends on the symbol alone."""
        return self.descend(symbol, at) - first

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            ones = level.rank1(at)
            at = np.where(one, level.zeros + ones, at - ones)
        return at


def ranks(text: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """By power of two up to length: the order of each position's next so many symbols."""
    out, rank, span = {}, np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    out[1] = rank
    while span < length:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
        span *= 2
        out[span] = rank
    return out


class FMIndex:
    """text: symbols, 0 parts texts. Suffixes are sorted by their first symbols, at least `length` of them, which is all that patterns up to that length need."""

    def __init__(self, text: np.ndarray, length: int):
        if length < 2:
            raise ValueError("patterns of two symbols at least")
        self.text, self.length = text, length
        found = ranks(text, length)
        self.order = np.argsort(found[max(found)], kind="stable")
        self.transform = text[self.order - 1]
        self.tree = WaveletMatrix(self.transform)
        count = np.bincount(text)
        self.less = np.concatenate([[0], np.cumsum(count)])
        self.firsts = self.tree.descend(np.arange(len(count)), np.zeros(len(count), dtype=np.int64))
        # Suffixes that share their first `length` symbols are neighbours: one group.
        half = 1 << (length.bit_length() - 1)
        if half == length:
            key = found[half]
        else:
            tail = np.zeros_like(found[half])
            shift = length - half
            tail[: len(text) - shift] = found[half][shift:] + 1
            key = found[half] * (int(found[half].max()) + 2) + tail
        sorted_key = key[self.order]
        self.group_starts = np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1])
        self.group = np.zeros(len(text), dtype=np.int64)
        self.group[self.group_starts[1:]] = 1
        self.group = np.cumsum(self.group)
        self.group_ends = np.append(self.group_starts[1:], len(text))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes of [low, high) after one more symbol in front."""
        first, base = self.firsts[symbol], self.less[symbol]
        return base + self.tree.rank(symbol, low, first), base + self.tree.rank(symbol, high, first)

    def matches(self, starts: np.ndarray, lengths: np.ndarray, query: np.ndarray | None = None):
        """Matching statistics of query texts, from right to left and capped at `length`.

        Yields (queries still going, their position, match length, low, high). A match that would
        pass the cap loses its last symbol: its range becomes that of its group."""
        query = self.text if query is None else query
        n = len(self.text)
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), n)
        have = np.zeros(len(starts), dtype=np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > back)
            at = lengths[live] - 1 - back
            symbol = query[starts[live] + at]
            known = (symbol > 0) & (symbol < len(self.less) - 1)
            safe = np.where(known, symbol, 0)
            a, b = self.extend(safe, low[live], high[live])
            got = known & (a < b)
            # No such match: start again from this symbol alone.
            once = known & ~got
            a, b = np.where(once, self.less[safe], a), np.where(once, self.less[safe + 1], b)
            size = np.where(got, have[live] + 1, np.where(once & (a < b), 1, 0))
            a, b = np.where(size > 0, a, 0), np.where(size > 0, b, n)
            over = size > self.length
            group = self.group[a[over]]
            a[over], b[over] = self.group_starts[group], self.group_ends[group]
            size[over] = self.length
            low[live], high[live], have[live] = a, b, size
            yield live, at, size, a, b
