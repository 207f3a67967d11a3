"""A wavelet matrix of token ids in one compressed file, with rank and select.

The file: ``WVLT1``, a header's length (4 bytes, little-endian) and the header (JSON: counts, and name, offset,
length and raw length of each section), then the sections, each a zstd frame: the distinct ids (u32), the
documents' ids (i64) and token offsets (u64), and, for each bit of an id's rank among the distinct ids from
the highest on, the bits in that level's order (packed, first bit highest) and the ones before each block of
512 bits (u32). A reader inflates only the sections that it needs.
"""

from __future__ import annotations

import json
import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WVLT1"
BLOCK = 512


def encode(ids: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """ids in a row; offsets: where each document's begin, and the end (one more than doc_ids)."""
    if len(ids) and int(ids.max()) < 1 << 20:  # a table of all ids is smaller than a sort
        there = np.zeros(int(ids.max()) + 1, bool)
        there[ids] = True
        symbols = np.flatnonzero(there).astype(np.uint32)
        table_of = (np.cumsum(there) - 1).astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        ranks = table_of[ids]
    else:
        symbols, ranks = np.unique(ids.astype(np.uint32), return_inverse=True)
        ranks = ranks.astype(np.uint32)
    levels = max(1, int(len(symbols) - 1).bit_length())
    sections = {"symbols": symbols, "doc_ids": doc_ids.astype("<i8"), "offsets": offsets.astype("<u8")}
    zeros = []
    for level in range(levels):
        bits = (ranks & ranks.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % BLOCK, bool))))
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        sections[f"bits{level}"] = packed
        sections[f"ones{level}"] = (np.cumsum(ones) - ones).astype("<u4")
        ranks = np.concatenate((ranks.compress(~bits), ranks.compress(bits)))
        zeros.append(int(len(bits) - bits.sum()))
    out, table, at, press = [], {}, 0, zstandard.ZstdCompressor(level=1)
    for name, x in sections.items():
        raw = x.tobytes()
        frame = press.compress(raw)
        table[name] = [at, len(frame), len(raw)]
        out.append(frame)
        at += len(frame)
    header = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "sections": table}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(out)


class WaveletMatrix:
    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", data[5:9])
        head = json.loads(data[9 : 9 + size])
        self.n, self.levels, self.zeros, self._sections = head["n"], head["levels"], head["zeros"], head["sections"]
        self._data, self._base, self._planes = data, 9 + size, {}

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, size, raw = self._sections[name]
        frame = self._data[self._base + at : self._base + at + size]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame, max_output_size=raw), kind)

    @cached_property
    def symbols(self) -> np.ndarray:
        return self._section("symbols", "<u4")

    @cached_property
    def doc_ids(self) -> np.ndarray:
        return self._section("doc_ids", "<i8")

    @cached_property
    def offsets(self) -> np.ndarray:
        return self._section("offsets", "<u8").astype(np.int64)

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            self._planes[level] = self._section(f"bits{level}", "u1"), self._section(f"ones{level}", "<u4")
        return self._planes[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        bits, ones = self._plane(level)
        if i >= len(bits) * 8:
            return self.n - self.zeros[level]
        block = i // BLOCK
        part = bits[block * (BLOCK // 8) : i // 8]
        rest = int(bits[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(ones[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a level is."""
        bits, ones = self._plane(level)
        before = ones if bit else np.arange(len(ones), dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        own = np.unpackbits(bits[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank = 0
        for level in range(self.levels):
            before = self._rank1(level, i)
            bit = self._rank1(level, i + 1) - before
            rank = rank << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return int(self.symbols[rank])

    def _path(self, token: int) -> int | None:
        r = int(np.searchsorted(self.symbols, token))
        return r if r < len(self.symbols) and self.symbols[r] == token else None

    def rank(self, token: int, i: int) -> int:
        """How often a token is among the first i tokens."""
        r = self._path(token)
        if r is None:
            return 0
        start, end = 0, min(max(i, 0), self.n)
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if r >> (self.levels - 1 - level) & 1 else (start - a, end - b)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of a token's k-th occurrence, from 0."""
        r = self._path(token)
        if r is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        start = 0
        for level in range(self.levels):
            a = self._rank1(level, start)
            start = self.zeros[level] + a if r >> (self.levels - 1 - level) & 1 else start - a
        at = start + k
        for level in range(self.levels - 1, -1, -1):
            bit = r >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every token in a row: the levels undone from the last."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ranks = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self._plane(level)[0], count=self.n).astype(bool)
            before = np.empty_like(ranks)
            before[np.flatnonzero(~bits)] = ranks[: self.zeros[level]]  # far faster than by masks of no pattern
            before[np.flatnonzero(bits)] = ranks[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            ranks = before
        return self.symbols[ranks] if self.n else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The tokens of the file's k-th document."""
        return np.array([self.access(i) for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))], np.uint32)
