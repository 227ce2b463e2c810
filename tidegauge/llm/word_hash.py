"""128-bit hashes of all words of many texts at once, in numpy.

A word of up to ``WIDE`` bytes is hashed by two independent tables of random
64-bit values for (place, byte): the values of its bytes are added up, which
tells any two words apart with a chance of 2**-128 to the contrary. A longer word
takes the 128-bit XXH3 of its bytes. Words are runs of anything but U+0009 to
U+000D and U+0020; A-Z is lower-cased. Bytes are worked on in slices of about
``SLICE``, cut between words, so that temporaries stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WIDE = 64
SLICE = 1 << 20


def finalise(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class WordHasher:
    """Hashes of the words of texts: two 64-bit numbers a word."""

    def __init__(self, seed: int = 11):
        self.tables = np.random.default_rng(seed).integers(0, 2**64, (2, WIDE * 256), np.uint64)
        self.seed = seed
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half, second half of the hash of each word of all texts in order, number of words of each text)."""
        coded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
        parts = [self._slice(data[a:b]) for a, b in self._cuts(data)]
        h, g, starts = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.uint64) for n in range(3))
        if len(parts) > 1:
            at = np.array([a for a, _ in self._cuts(data)], np.int64)
            starts = starts + np.repeat(at, [len(p[0]) for p in parts])
        offsets = np.cumsum(np.array([len(c) + 1 for c in coded], np.int64))
        return h, g, np.diff(np.r_[0, np.searchsorted(starts, offsets)])

    def _cuts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            while end < len(data) and not self.space[data[end - 1]]:
                # To the next space, wherever it is.
                found = np.flatnonzero(self.space[data[end : end + SLICE]])
                end = end + int(found[0]) + 1 if len(found) else min(end + SLICE, len(data))
            yield at, end
            at = end

    def _slice(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and first places of the words of whole-word ``data``."""
        inside = np.flatnonzero(~self.space[data])
        if not len(inside):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
        lengths = np.diff(np.r_[first, len(inside)])
        place = np.arange(len(inside)) - np.repeat(first, lengths)
        key = np.minimum(place, WIDE - 1) * 256 + data[inside]
        h, g = (finalise(np.add.reduceat(t[key], first) ^ lengths.astype(np.uint64)) for t in self.tables)
        starts = inside[first]
        for n in np.flatnonzero(lengths > WIDE):
            whole = xxhash.xxh3_128_intdigest(data[starts[n] : starts[n] + lengths[n]].tobytes(), self.seed)
            h[n], g[n] = whole >> 64, whole & (1 << 64) - 1
        return h, g, starts


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, g of each distinct pair, sorted by h; where each row is among them)."""
    first, at, place = np.unique(h, return_index=True, return_inverse=True)
    second = g[at]
    if (second[place] == g).all():
        return first, second, place
    order = np.lexsort((g, h))
    fresh = np.r_[True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return h[order][fresh], g[order][fresh], place
