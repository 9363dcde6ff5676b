"""Vectorised hashing of words and word windows, for use inside Arrow tasks.

A word's hash is the sum, mod 2**64, of one pseudo-random number for each
(position, byte), mixed once more: distinct words collide with a chance of
about 2**-64. Windows combine word hashes by position in the same manner.
"""

from __future__ import annotations

import functools

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _table() -> np.ndarray:
    """A number for each of the first 256 positions and each byte."""
    return mix((np.arange(1 << 16, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


def hash_runs(chars: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; the runs stand one after the other, each of ``n`` bytes, one at least."""
    if not len(n):
        return np.zeros(0, dtype=np.uint64)
    at = np.cumsum(n) - n
    place = np.arange(len(chars)) - np.repeat(at, n)
    if int(n.max()) <= 256:
        value = _table()[(place << 8) | chars]
    else:
        value = mix((((place.astype(np.uint64) << _U(8)) | chars) + _U(1)) * _U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, at))


_FREE = np.iinfo(np.uint64).max


class Table:
    """The place of each of many distinct numbers in the order they came, in an open-addressing table."""

    def __init__(self, keys: np.ndarray = np.zeros(0, dtype=np.uint64)) -> None:
        self.n = 0
        self._make(len(keys))
        self.add(keys)

    def _make(self, n: int) -> None:
        self.bits = max(10, (n * 4 // 3).bit_length())
        self.keys, self.place = np.full(1 << self.bits, _FREE, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            took = todo[self.keys[slot[todo]] == _FREE]
            self.keys[slot[took]] = keys[took]  # of several at one slot the last stays
            self.place[slot[took]] = places[took]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def add(self, keys: np.ndarray) -> None:
        """New keys, none of which is in the table."""
        if (self.n + len(keys)) * 4 // 3 >= 1 << self.bits:
            keys_, places = self.keys[self.place >= 0], self.place[self.place >= 0]
            self._make(2 * (self.n + len(keys)))
            self._put(keys_, places)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 if it isn't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        todo = np.flatnonzero((there != keys) & (there != _FREE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            todo = todo[(there != keys[todo]) & (there != _FREE)]
        return self.place[slot]


@functools.lru_cache(32)
def _some_powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), mod 2**64."""
    return _some_powers(base, max(n - 1, 1).bit_length())[:n]


class Words:
    """The words of several texts.

    ``start`` and ``end`` are byte places in ``data``; ``first[d]`` to
    ``first[d + 1]`` are the words of text ``d``; ``hash`` holds one number a word.
    """

    def __init__(self, texts: list[bytes], lower: bool) -> None:
        self.data = b" ".join(texts) + b" "
        if lower:
            self.data = self.data.lower()  # bytes: A-Z alone
        buf = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.ones(len(buf) + 1, dtype=bool)
        inside[0] = False
        np.logical_not((buf == 32) | ((buf >= 9) & (buf <= 13)), out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.start, begins)
        self.hash = hash_runs(buf[inside[1:]], self.end - self.start)

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """A hash for the k words from each word on; those that leave their text are of no meaning."""
        h = self.hash
        n = max(len(h) - k + 1, 0)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        base = int(mix(np.array([salt + 1], dtype=np.uint64) * _U(0xD1342543DE82EF95))[0]) | 1
        # sums of h[i] * base**i, less those before, times base**-i: mod 2**64 an odd base has an inverse
        power, back = _powers(base, len(h)), _powers(pow(base, -1, 1 << 64), n)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * power, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * back)

    def doc_of_window(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the range of its windows of k words: (first, end), equal if there is none."""
        return self.first[:-1], np.maximum(self.first[1:] - (k - 1), self.first[:-1])
