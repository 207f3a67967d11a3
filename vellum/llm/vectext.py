"""Vectorised scanning of many texts at once.

A chunk of texts becomes one array of code points with a separator after each text; words are runs of a
character class in it, and every word gets a 64-bit hash, all without a Python step per word. Memory is
proportional to ``CHUNK`` code points, or to a single text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points that are looked at together.
CHUNK = 600_000
#: Stands between texts; no code point has this number.
SEP = 0x110000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's base and of its inverse, at least n of each."""
    return _powers(max(CHUNK + 100_000, 1 << (n - 1).bit_length() if n > CHUNK + 100_000 else 0))


class Chunk:
    """Texts as one array of code points; text i is ``codes[off[i] : off[i + 1] - 1]``."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=self.off[1:])
        self.codes[self.off[1:] - 1] = SEP

    def text(self, start: int, end: int) -> str:
        return self.codes[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def hashes(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each span; equal spans have equal hashes in every process."""
        codes = self.codes if codes is None else codes
        p, q = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """Where each text's spans begin among the spans with these ascending starts, and the number of all."""
        return np.searchsorted(starts, self.off)


def chunks(texts: list[str]) -> Iterator[tuple[int, int, Chunk]]:
    """Consecutive slices of the texts, each of at most CHUNK code points or one text."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield start, i, Chunk(texts[start:i])
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts), Chunk(texts[start:])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value must be false."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    return codes + (((codes - np.uint32(65)) < 26).astype(np.uint32) << np.uint32(5))


def white(codes: np.ndarray) -> np.ndarray:
    """Space, tab to carriage return, or the end of a text."""
    return (codes == 32) | ((codes - np.uint32(9)) < 5) | (codes == SEP)


def spaced_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased: starts, hashes, and where each text's words begin."""
    starts, ends = runs(~white(chunk.codes))
    return starts, chunk.hashes(starts, ends, lower_ascii(chunk.codes)), chunk.per_text(starts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, wherever a window can begin; windows over several texts included."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + words[j : j + m]
    return mix(out)


def hash_text(text: str) -> int:
    """The hash that a word of this text gets."""
    c = Chunk([text])
    return int(c.hashes(np.array([0]), np.array([len(text)]))[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 for all i, in a row."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class Numbers:
    """Numbers 0, 1, 2, ... of distinct 64-bit hashes, in the order they were added: open addressing over arrays.

    A hash costs about one random access, where a search in a sorted table costs one for each halving.
    """

    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return self._n

    def clear(self) -> None:
        self._n = 0
        self._room(1 << 12)

    def _room(self, slots: int) -> None:
        self._mask, self._shift = slots - 1, np.uint64(65 - slots.bit_length())
        self._keys, self._numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 for those not added."""
        slot = (hashes >> self._shift).astype(np.int64)
        out = self._numbers[slot]
        todo = np.flatnonzero((out >= 0) & (self._keys[slot] != hashes))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self._mask
            found = self._numbers[slot]
            out[todo] = found
            other = (found >= 0) & (self._keys[slot] != hashes[todo])
            todo, slot = todo[other], slot[other]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Numbers distinct hashes, none of them added before."""
        need = 2 * (self._n + len(hashes))
        if need > self._mask:
            used = self._numbers >= 0
            keys, numbers = self._keys[used], self._numbers[used]
            self._room(1 << need.bit_length())
            self._place(keys, numbers)
        self._place(hashes, np.arange(self._n, self._n + len(hashes), dtype=np.int32))
        self._n += len(hashes)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = (keys >> self._shift).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self._numbers[slot] < 0)
            self._numbers[slot[free]] = numbers[free]  # of several for one slot, one stays
            self._keys[slot[free]] = keys[free]
            rest = self._numbers[slot] != numbers
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + 1) & self._mask
