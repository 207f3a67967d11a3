"""N-gram Jaccard join: an exact self-join of shingle sets in the metric space of the Jaccard distance.

Documents of equal sets are one class from the start. In this space unrelated texts are all at distance 1, so
pivots that are documents cannot divide a corpus; its first pivots are all sets of one shingle, at distance 1 - 1 / n
from the sets of n that hold them and 1 from all others. A set's nearest pivots are those of its own shingles, of which
the first in one global order is its home; the triangle inequality with radius r = 1 - threshold leaves a window of
pivots that its partners can be at home with: its first n - ceil(threshold * n) + 1 shingles. Boundary sets are
copied to these cells as ids only. Then:

1. Elimination. With a window longer by l, a linked pair shares l shingles within both windows, so a class
   with fewer windows shingles in other classes has no link. This drops nearly all of a corpus.
2. Cells. Each of the survivors' shingles is counted and its count goes back to the classes that have it. A class's
   window is taken in the order of these counts, rarest first, so that passages which many documents share make no
   cells; shingles that no other survivor has fill the window first, and a class that they fill has no link.
   Cells that share a set are one region: a linked pair is always within one region.
3. Regions are joined recursively and exactly by document pivots, their Voronoi cells and copies of boundary sets:
   see ``voronoi``. No region is gathered unless it is small.

Texts are shingled twice: once for the elimination, once for the sets of the survivors. Hashes of shingles and sets have
64 bits. Distances are computed on whole sets; no candidate, partner or bucket is capped.

Defined results: a null text, or one without words, has the empty set and links with nothing; fewer words than
five make one shingle; rows without doc_id are components of their own ids' null; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import voronoi
from .common import lean, packed_row, row_schema, table, texts_of, written
from .components import as_rows, bucket_of, components, packed
from .ordered import parts_for
from .vectext import chunks, mix, spaced_words, window_hashes

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Places that a task holds before it sends them on.
HELD = 500_000
#: Counts of shingles are told apart below this.
MANY = 255


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


def window(n, percent: int = PERCENT):
    return n - least_shared(n, percent) + 1


def margin(n):
    """By how much the elimination's window is longer, plus one."""
    return np.maximum(n // 10, 1)


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted, distinct shingle hashes."""
    for a, b, chunk in chunks(texts):
        _, hashes, first = spaced_words(chunk)
        grams = window_hashes(hashes, words)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= words:
                yield np.unique(grams[lo : hi - words + 1])
            elif hi > lo:
                h = np.uint64(hi - lo)
                yield mix(np.array([np.bitwise_xor.reduce(mix(hashes[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))], np.uint64) + h)
            else:
                yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """A set's 64-bit name; never 0, which stands for several."""
    h = mix(np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], np.uint64) + np.uint64(len(s)))
    return int(h[0].view(np.int64)) or 1


#: kind 0: window places, shingles ``a`` (32 bits), owners ``b`` (0 for several) and their sizes ``c``; 1: classes ``a``, their shared
#: places ``b`` and sizes ``c``; 2: documents, their classes ``a``, ids ``b`` (null: not in ``d``) and sizes ``c``.
SCAN = "bucket int, kind int, a binary, b binary, c binary, d binary"


def _rows(kind: int, buckets, *columns: list[bytes]) -> pa.RecordBatch:
    n = len(buckets)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([kind] * n, pa.int32()), *(pa.array(x, pa.binary()) for x in columns), *(pa.nulls(n, pa.binary()) for _ in range(4 - len(columns)))], names=["bucket", "kind", "a", "b", "c", "d"])


def _shared_rows(parts: int, cid: np.ndarray, shared: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    some, columns = packed(parts, bucket_of(cid, parts), cid, shared.astype(np.int32), n.astype(np.int64))
    return _rows(1, some, *columns)


def short(shingles: np.ndarray, parts: int) -> np.ndarray:
    """A shingle's bucket and 32 more bits of it: what places are told apart by."""
    return shingles % np.uint64(parts) << np.uint64(32) | shingles >> np.uint64(8) & np.uint64(0xFFFFFFFF)


class Places:
    """Shingles of classes, of which a block sends on each once: by bucket, with the owner or 0 for several; and what it knows of sharing."""

    def __init__(self, parts: int):
        self.parts = parts
        self._begin()

    def _begin(self) -> None:
        self.seen: set[int] = set()
        self.shingles: list[np.ndarray] = []
        self.owners: list[int] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, cid: int, x: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        self.seen.add(cid)
        self.shingles.append(x)
        self.owners.append(cid)
        self.sizes.append(n)
        self.held += len(x)
        if self.held > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        at = np.repeat(np.arange(len(self.owners)), [len(x) for x in self.shingles])
        s = short(np.concatenate(self.shingles), self.parts)
        cid, n_of = np.array(self.owners, np.int64), np.array(self.sizes, np.int64)
        self._begin()
        order = np.argsort(s, kind="stable")
        s, at = s[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        n = np.diff(np.append(first, len(s)))
        known, count = np.unique(at[np.repeat(n > 1, n)], return_counts=True)
        yield _shared_rows(self.parts, cid[known], count, n_of[known])
        one, s = at[first], s[first]
        values = [s.astype(np.uint32), np.where(n > 1, 0, cid[one]), np.where(n > 1, 0, n_of[one]).astype(np.int32)]
        some, columns = packed(self.parts, (s >> np.uint64(32)).astype(np.int64), *values)
        yield _rows(0, some, *columns)


def _scan(words: int, percent: int, parts: int):
    """Documents and their classes; the places of the classes' windows, made longer by their margin."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, turn = Places(parts), 0
        for batch in batches:
            ids = batch.column("doc_id")
            known, values = np.array(ids.is_valid()), ids.fill_null(0).to_numpy()
            classes, counts = [], []
            for x in shingle_sets(texts_of(batch), words):
                n = len(x)
                cid = class_of(x) if n else 0
                classes.append(cid)
                counts.append(n)
                if n and cid not in places.seen:
                    yield from places.add(cid, x[: min(n, int(window(n, percent) - 1 + margin(n)))], n)
            turn = (turn * 31 + len(counts) + sum(counts)) % parts
            yield _rows(2, [turn], *([x.tobytes()] for x in (np.array(classes, np.int64), values.astype(np.int64), np.array(counts, np.int64), known)))
        yield from places.flush()

    return f


def _share(parts: int):
    """How many of a class's places in this bucket other classes have, too, by bucket of the class; other rows as they are."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kind = np.array(batch.column("kind"))
            own = batch.filter(pa.array(kind == 0))
            for columns in zip(*(own.column(x).to_pylist() for x in "abc"), strict=True):
                held.append(tuple(np.frombuffer(x, t) for x, t in zip(columns, (np.uint32, np.int64, np.int32), strict=True)))
            rest = batch.filter(pa.array(kind != 0))
            if rest.num_rows:
                at = [int(bucket_of(np.frombuffer(x, np.int64, 1), parts)[0]) for x in rest.column("a").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *rest.columns[1:]], names=rest.schema.names)
        if not held:
            return
        s, o, n = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((o, s))
        s, o, n = s[order], o[order], n[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])))
        s, o, n = s[new], o[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        k = np.diff(np.append(first, len(s)))
        several = np.repeat((k > 1) | (o[first] == 0), k) & (o != 0)
        known, at, count = np.unique(o[several], return_index=True, return_counts=True)
        yield _shared_rows(parts, known, count, n[several][at])

    return f


def _survive(percent: int):
    """Of the classes of one bucket, those that share as many places as their size needs, at least; one row."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, shared, sizes = [], [], []
        bucket = None
        for batch in batches:
            for k, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "a", "b", "c")), strict=True):
                bucket = k
                cid.append(np.frombuffer(a, np.int64))
                shared.append(np.frombuffer(b, np.int32))
                sizes.append(np.frombuffer(c, np.int64))
        if cid:
            some, at, which = np.unique(np.concatenate(cid), return_index=True, return_inverse=True)
            total = np.bincount(which, np.concatenate(shared))
            n = np.concatenate(sizes)[at]
            some = some[total >= np.maximum(least_shared(n, percent) // 10, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([some.tobytes()], pa.binary()), pa.array([len(some)], pa.int64())], names=["bucket", "cids", "k"])

    return f


#: Bits of a filter at most: 16 MB.
MOST_BITS = 1 << 27


def _bit(cids: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """A class's place in the filter; its bucket's places follow each other, ``bits`` of them."""
    return bucket_of(cids, parts) * bits + (mix(cids.view(np.uint64) + np.uint64(1)) % np.uint64(bits)).astype(np.int64)


def _segment(parts: int, bits: int, column: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist(), strict=True):
                held = np.zeros(bits, bool)
                held[_bit(np.frombuffer(raw, np.int64), parts, bits) - k * bits] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bucket", "bits"])

    return f


def bitmap(cids: DataFrame, column: str, count: int, parts: int) -> tuple[np.ndarray, int, int]:
    """Bits at the places of packed classes, a row a bucket: a filter of bounded size that lets all of them pass."""
    bits = max(64, min(MOST_BITS, 1 << (16 * count).bit_length()) // parts // 8 * 8)
    out = np.zeros(parts * bits // 8, np.uint8)
    for r in cids.select("bucket", column).mapInArrow(lean(_segment(parts, bits, column)), "bucket int, bits binary").collect():
        out[r.bucket * bits // 8 : (r.bucket + 1) * bits // 8] |= np.frombuffer(r.bits, np.uint8)
    return out, parts, bits


def passing(cids: np.ndarray, filter_: tuple[np.ndarray, int, int]) -> np.ndarray:
    held, parts, bits = filter_
    at = _bit(cids, parts, bits)
    return (held[at // 8] >> (7 - at % 8).astype(np.uint8) & 1).astype(bool)


SETS = "cid long, shingles binary"


def _sets(shared, words: int):
    """Classes that the filter lets pass, each once a task, and their sets."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = [(class_of(x), x) for x in shingle_sets(texts_of(batch), words) if len(x)]
            keep = passing(np.array([c for c, _ in found], np.int64), shared.value)
            cids, raw = [], []
            for (cid, x), k in zip(found, keep.tolist(), strict=True):
                if k and cid not in seen:
                    seen.add(cid)
                    cids.append(cid)
                    raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(raw, pa.binary())], names=["cid", "shingles"])

    return f


#: kind 0: places by bucket of the shingle, shingles ``a``, their owners' numbers ``b`` in ``c``, whose sizes are ``d`` (owner 0: of many);
#: 1: places by bucket of the class, shingles ``a`` and their counts ``b`` (8 bits) in the order of the classes ``c``, whose sizes and numbers of places are ``d``.
COUNTED = "bucket int, kind int, a binary, b binary, c binary, d binary"


def _by_shingle(parts: int, s: np.ndarray, at: np.ndarray, cid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    bucket = (s % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(parts + 1))
    some, columns = np.flatnonzero(np.diff(edge)), [[], [], [], []]
    for b in some:
        own = order[edge[b] : edge[b + 1]]
        owners, number = np.unique(at[own], return_inverse=True)
        for column, x in zip(columns, (s[own], number.astype(np.uint32), cid[owners], n[owners].astype(np.int32)), strict=True):
            column.append(x.tobytes())
    return _rows(0, some, *columns)


def _by_class(parts: int, s: np.ndarray, count: np.ndarray, cid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    bucket = bucket_of(cid, parts)
    order = np.lexsort((cid, bucket))
    bucket, cid = bucket[order], cid[order]
    edge = np.searchsorted(bucket, np.arange(parts + 1))
    some, columns = np.flatnonzero(np.diff(edge)), [[], [], [], []]
    for b in some:
        own = order[edge[b] : edge[b + 1]]
        names, first, k = np.unique(cid[edge[b] : edge[b + 1]], return_index=True, return_counts=True)
        for column, x in zip(columns, (s[own], count[own].astype(np.uint8), names, np.stack((n[own[first]], k)).astype(np.int32)), strict=True):
            column.append(x.tobytes())
    return _rows(1, some, *columns)


def _places(parts: int):
    """The shingles of the sets, to be counted; those that a block has in many sets are known to be frequent."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cid, n = np.array(cids, np.int64), np.fromiter(map(len, sets), np.int64, len(sets))
            s, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            order = np.argsort(s, kind="stable")
            s, at = s[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            k = np.diff(np.append(first, len(s)))
            many = np.repeat(k >= MANY, k)
            if many.any():
                yield _by_class(parts, s[many], np.full(int(many.sum()), MANY), cid[at[many]], n[at[many]])
                s, at = np.concatenate((s[~many], s[first[k >= MANY]])), np.concatenate((at[~many], np.full(int((k >= MANY).sum()), len(cid))))
            yield _by_shingle(parts, s, at, np.append(cid, 0), np.append(n, 0))

        for batch in batches:
            for cid, raw in zip(batch.column("cid").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                cids.append(cid)
                sets.append(np.frombuffer(raw, np.uint64))
                held += len(sets[-1])
                if held > HELD:
                    yield from flush()
                    cids, sets, held = [], [], 0
        if held:
            yield from flush()

    return f


def _count(parts: int):
    """The shingles of one bucket that several classes have, with their counts, to these classes."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            kind = np.array(batch.column("kind"))
            rest = batch.filter(pa.array(kind == 1))
            if rest.num_rows:
                at = [int(bucket_of(np.frombuffer(x, np.int64, 1), parts)[0]) for x in rest.column("c").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *rest.columns[1:]], names=rest.schema.names)
            own = batch.filter(pa.array(kind == 0))
            for a, b, c, d in zip(*(own.column(x).to_pylist() for x in "abcd"), strict=True):
                at = np.frombuffer(b, np.uint32)
                held.append((np.frombuffer(a, np.uint64), np.frombuffer(c, np.int64)[at], np.frombuffer(d, np.int32)[at]))
        if not held:
            return
        s, o, n = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((o, s))
        s, o, n = s[order], o[order], n[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])))
        s, o, n = s[new], o[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        k = np.diff(np.append(first, len(s)))
        count = np.repeat(np.minimum(np.add.reduceat(np.where(o == 0, MANY, 1), first), MANY), k)
        some = (count > 1) & (o != 0)
        if some.any():
            yield _by_class(parts, s[some], count[some], o[some], n[some])

    return f


#: Bucket -1: edges between classes ``a`` and ``b``; others: cells ``a`` and their owners ``b``.
CELLS = "bucket int, a binary, b binary"


def _cell_rows(buckets, a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "a", "b"])


def _meet(s: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells and each one's least owner; edges from it to the cell's other owners."""
    order = np.lexsort((o, s))
    s, o = s[order], o[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    least = np.repeat(o[first], np.diff(np.append(first, len(s))))
    some = least != o
    return s[first], o[first], least[some], o[some]


def _windows(percent: int, parts: int):
    """The windows of one bucket's classes, as cells; of a cell's classes here all meet the least one, which alone goes on."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in "abcd"), strict=True):
                n, k = np.frombuffer(d, np.int32).reshape(2, -1)
                held.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint8), np.repeat(np.frombuffer(c, np.int64), k), np.repeat(n, k)))
        if not held:
            return
        s, count, o, n = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((s, count, o))
        s, o, n = s[order], o[order], n[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])))  # copies of a class came from several tasks
        s, o, n = s[new], o[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        k = np.diff(np.append(first, len(o)))
        rank = np.arange(len(o)) - np.repeat(first, k)
        inside = rank < window(n.astype(np.int64), percent) - (n - np.repeat(k, k))
        s, o, a, b = _meet(s[inside], o[inside])
        if len(a):
            yield _cell_rows([-1], [a.tobytes()], [b.tobytes()])
        some, (cell, owner) = packed(parts, (s % np.uint64(parts)).astype(np.int64), s, o)
        yield _cell_rows(some, cell, owner)

    return f


def _cells_reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one bucket's cells; edges as they are."""
    s, o = [], []
    for batch in batches:
        for k, a, b in zip(*(batch.column(x).to_pylist() for x in ("bucket", "a", "b")), strict=True):
            s.append(np.frombuffer(a, np.uint64))
            o.append(np.frombuffer(b, np.int64))
    if s:
        _, _, a, b = _meet(np.concatenate(s), np.concatenate(o))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])


def _with_bucket(parts: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid")
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(cid.to_numpy(), parts), pa.int32()), cid, batch.column("shingles"), pa.nulls(batch.num_rows, pa.binary())], names=["bucket", "cid", "shingles", "regions"])

    return f


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, the names of the regions, which come first, and the sets: each class's set once, if it has a region."""
    nodes = regions = np.zeros(0, np.int64)
    done = np.zeros(0, bool)
    for batch in batches:
        cids, raw = batch.column("cid"), batch.column("regions").to_pylist()
        known = [(n, r) for n, r in zip(batch.column("shingles").to_pylist(), raw, strict=True) if r is not None]
        if known:
            nodes, at = np.unique(np.concatenate([nodes, *(np.frombuffer(n, np.int64) for n, _ in known)]), return_index=True)
            regions = np.concatenate([regions, *(np.frombuffer(r, np.int64) for _, r in known)])[at]
            done = np.zeros(len(nodes), bool)
        some = np.flatnonzero([r is None for r in raw])
        if not len(some) or not len(nodes):
            continue
        values = cids.take(pa.array(some)).to_numpy()
        at = np.searchsorted(nodes, values)
        at[at == len(nodes)] = 0
        new = (nodes[at] == values) & ~done[at]
        _, first = np.unique(values, return_index=True)
        only = np.zeros(len(values), bool)
        only[first] = True
        new &= only
        done[at[new]] = True
        rows = pa.array(some[new])
        yield pa.RecordBatch.from_arrays([pa.array(regions[at[new]]), cids.take(rows), batch.column("shingles").take(rows)], names=["region", "cid", "shingles"])


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in "abcd"), strict=True):
            cid = np.frombuffer(a, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b, np.int64), mask=~np.frombuffer(d, bool)), pa.array(np.frombuffer(c, np.int64)), pa.array(cid, mask=cid == 0)], names=["doc_id", "n", "cid"])


def labels(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit_bytes: int = voronoi.LIMIT_BYTES, limit_sets: int = voronoi.LIMIT_SETS) -> tuple[DataFrame, DataFrame]:
    """Tables of members (doc_id, n, cid: the class, null without shingles) and of linked classes (cid, label: the component's least class)."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    shared = written(slim.mapInArrow(lean(_scan(words, percent, parts)), SCAN).repartitionById(parts, F.col("bucket")).mapInArrow(lean(_share(parts)), SCAN), "shared")
    members = shared.where("kind = 2").select("a", "b", "c", "d").mapInArrow(lean(_members), "doc_id long, n long, cid long")
    survivors = written(shared.where("kind = 1").select("bucket", "a", "b", "c").repartitionById(parts, F.col("bucket")).mapInArrow(lean(_survive(percent)), "bucket int, cids binary, k long"), "survivors")
    passing_ = spark.sparkContext.broadcast(bitmap(survivors, "cids", int(survivors.agg(F.sum("k")).first()[0] or 0), parts))
    sets = written(slim.select("text").mapInArrow(lean(_sets(passing_, words)), SETS), "sets")

    counted = sets.mapInArrow(lean(_places(parts)), COUNTED).repartitionById(parts, F.col("bucket")).mapInArrow(lean(_count(parts)), COUNTED)
    cells = written(counted.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_windows(percent, parts)), CELLS), "cells")
    meets = cells.where("bucket >= 0").repartitionById(parts, F.col("bucket")).mapInArrow(lean(_cells_reduce), voronoi.PACKED)
    regions = components(meets.unionByName(cells.where("bucket = -1").select("a", "b")))

    names = regions.select("bucket", F.lit(None).cast("long").alias("cid"), F.col("a").alias("shingles"), F.col("b").alias("regions"))
    both = names.unionByName(sets.mapInArrow(lean(_with_bucket(parts)), "bucket int, cid long, shingles binary, regions binary"))
    placed = written(both.repartitionById(parts, F.col("bucket")).sortWithinPartitions(F.col("regions").isNull()).mapInArrow(lean(_place), "region long, cid long, shingles binary"), "placed")
    edges, again = voronoi.join_regions(placed, percent, limit_bytes, limit_sets)
    edges = written(edges, "links")
    if again:  # stars of several levels meet
        return members, as_rows(components(edges)).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    return members, as_rows(edges).select(F.col("component").alias("cid"), F.col("node").alias("label"))


def _named(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, each with its component's name: the least class, or null without shingles."""
    return members.join(found, "cid", "left").select("doc_id", "n", "cid", F.coalesce("label", "cid").alias("label"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit_bytes: int = voronoi.LIMIT_BYTES, limit_sets: int = voronoi.LIMIT_SETS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    named = written(_named(*labels(docs, words, percent, limit_bytes, limit_sets)), "named")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _key(cid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix(mix(cid.view(np.uint64)) ^ doc_id.view(np.uint64)).view(np.int64)


def _keyed(dropped, words: int):
    """Rows with the key of their class and id, or null if the filter of dropped keys doesn't hold it."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = np.array([class_of(x) if len(x) else 0 for x in shingle_sets(texts_of(batch), words)], np.int64)
            ids = batch.column("__vellum_id")
            key = _key(cid, ids.fill_null(0).to_numpy())
            asked = passing(key, dropped.value) & np.array(ids.is_valid()) & (cid != 0) if len(key) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(key, mask=~asked)], names=["row", "key"])

    return f


def _packed_keys(parts: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(batch.column("cid").to_numpy(), batch.column("doc_id").to_numpy())
            some, (keys,) = packed(parts, bucket_of(key, parts), key)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(keys, pa.binary()), pa.array([len(x) // 8 for x in keys], pa.int64())], names=["bucket", "keys", "k"])

    return f


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_key(batch.column("cid").to_numpy(), batch.column("doc_id").to_numpy())), batch.column("stays")], names=["key", "stays"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: one of the least doc_id's.

    Rows without doc_id, and those without words, stay; texts that don't link stay whether or not they share a doc_id.
    Only rows that may have to go, by a filter of at most 16 MB, are moved to be looked up.
    """
    parts = parts_for(docs)
    named = written(_named(*labels(docs)), "named").where("doc_id is not null and label is not null").select("doc_id", "cid", "label")
    kept = written(named.groupBy("label").agg(F.min(F.struct("doc_id", "cid")).alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("label", "least"), "kept")
    # with the rows that are kept: of their repetitions one stays
    linked = written(named.join(kept, "label").select("cid", "doc_id", (F.struct("doc_id", "cid") == F.col("least")).alias("stays")).distinct(), "linked")
    keys = written(linked.mapInArrow(lean(_packed_keys(parts)), "bucket int, keys binary, k long"), "linked-keys")
    count = int(keys.agg(F.sum("k")).first()[0] or 0)
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(keys, "keys", count, parts))

    row = docs.select(packed_row(docs.columns).alias("row"))
    slim = row.select("row", F.col("row.text").alias("text"), F.col("row.doc_id").cast("long").alias("__vellum_id"))
    found = written(slim.mapInArrow(lean(_keyed(asked, WORDS)), row_schema(row, "key long")), "keyed")
    verdict = linked.mapInArrow(lean(_keys), "key long, stays boolean")
    some = found.where("key is not null").join(verdict, "key", "left")
    passed = some.where("stays is null").select("row")  # false hits of the filter
    one = some.where("stays").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return found.where("key is null").select("row").unionByName(passed).unionByName(one).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
