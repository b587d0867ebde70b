"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and 0x09-0x0D, so UTF-8 text needs no decoding."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to so many bytes; one longer text is handled alone.
SLICE_BYTES = 2 << 20


def release() -> None:
    """Give freed memory back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


_powers: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root ** 0 .. n modulo 2 ** 64."""
    have = _powers.get(root)
    if have is None or len(have) < n:
        steps = np.full(max(n, 64), root, dtype=np.uint64)
        steps[0] = 1
        have = _powers[root] = np.cumprod(steps, dtype=np.uint64)
    return have


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of consecutive rows; null is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    first, held, size = 0, [], 0
    for i in range(len(column)):
        text = column[i].as_py() or b""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held
    held = []
    release()


class Words:
    """Words of some texts: starts, ends (byte positions in data), doc (text of each word), bounds (first word of each text, and the number of words)."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.buffer, dtype=np.uint8)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate([[0], np.cumsum(self.size + 1)])
        self.inside = ~SEPARATOR[self.data]
        edge = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(self.starts, self.base)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        return self.span_hashes(self.starts, self.ends, lane)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """The same for spans that the words are cut into, all of them in order."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        length = ends - starts
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(first, length)
        terms = (self.data[self.inside].astype(np.uint64) + np.uint64(1)) * powers(ROOTS[lane], int(length.max()))[at]
        return mixed(np.add.reduceat(terms, first) + length.astype(np.uint64))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.base[1:] - 1] - total[self.base[:-1]]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n - len(x), len(x)), dtype=x.dtype)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size of each, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class HashIndex:
    """Places 0, 1, .. of 64-bit hashes in order of arrival: open addressing over arrays, for many keys at once."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self.keys = np.zeros(1, dtype=np.uint64)
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it is not there."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.slots[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            out[rest] = self.slots[slot[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[out[rest]] != keys[rest])]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The places of distinct keys that are not there yet."""
        new = np.arange(self.n, self.n + len(keys))
        self.keys = grown(self.keys, self.n + len(keys))
        self.keys[new] = keys
        self.n += len(keys)
        if 2 * self.n > self.mask:
            self._size((4 * self.n).bit_length())
            self._enter(np.arange(self.n))
        else:
            self._enter(new)
        return new

    def _enter(self, places: np.ndarray) -> None:
        slot = (self.keys[places] >> self.shift).astype(np.int64)
        rest = np.arange(len(places))
        while len(rest):
            free = rest[self.slots[slot[rest]] < 0]
            self.slots[slot[free]] = places[free]
            rest = rest[self.slots[slot[rest]] != places[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive values; windows may cross texts, the caller masks them."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, seed, dtype=np.uint64)
    weight = powers(ROOTS[1], n + 1)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * weight[j + 1]
    return mixed(out)


def window_ok(words: Words, n: int) -> np.ndarray:
    """Whether the n words from each position are of one text."""
    if len(words) < n:
        return np.zeros(0, dtype=bool)
    return words.doc[: len(words) - n + 1] == words.doc[n - 1 :]
