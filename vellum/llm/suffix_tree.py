"""Language-model scoring by a probabilistic suffix tree.

A text is the sequence of its words (between ASCII white space, A-Z lower-cased) and an end. The tree spells
this sequence in symbols: the ``SYMBOLS`` most frequent code points, a space between words and the end. Other
code points are spelled by several symbols, which are in the tree as any: the next ``DIGITS`` by an escape and
a digit, the next ``DIGITS`` squared by another and two, all others (those not in the training rows too) by a
third and the four digits of their number. So the spelling and the sequence determine each other. A context of up to ``DEPTH`` symbols is a state if it has at least ``LEAST`` of all training
symbols and its next-symbol distribution diverges from that of its suffix by ``DIVERGENCE`` nats; the
suffixes of a state are states. Each distribution is smoothed with its suffix's, the root's with the
uniform one. A text's score adds, at each symbol, the log10 probability in the longest suffix that is a
state. ``LEAST`` bounds this part of the tree (at most 1 / LEAST states a depth), so it can be broadcast at any size.

The rest of the tree grows with the rows: whole words, of any length and frequency, are
contexts of the word that follows (its symbols and the space or end after it). Such a word is a state if training rows
hold it at least twice, at any size, and its distribution diverges from the shorter suffixes' (``word_state_gains``); it is
smoothed with theirs, so that the whole stays a distribution. These states stay in buckets by hash, with the word
counts, and the places in the texts come to them. A word that is broadcast (see below) has too many places for one
bucket: they go to buckets by the pair of words, and what is known of the word as a whole (its total, its distinct
followers, its divergence) is summed over the buckets, in two readings of one exchange before the one that scores.

The word counts behind ``base_score`` do not have such a bound: they stay in buckets by hash. Words of at least
``HOT`` of all training tokens and ``HOT_LEAST`` of them, of which there can be only 1 / HOT, are broadcast; the others' places in the
texts are packed by bucket and meet the counts there. Words are told apart by 64-bit hashes.

Defined results: null and empty texts are the end alone; rows without doc_id are training rows; repeated rows
are each scored; without any training row the base is that of N = V = 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, texts_of, written
from .ordered import parts_for
from .vectext import SEP, Chunk, chunks, lower_ascii, mix, runs, white

DEPTH = 5
SYMBOLS = 58
LEAST = 4e-6
DIVERGENCE = 0.001
SMOOTHING = 10.0
HOT = 1e-5
#: Words that occur less often than this are never HOT, so that small tables have states of whole words too.
HOT_LEAST = 100
#: Distinct words or grams that a task holds before it sends them on.
HELD = 1_500_000
#: Symbols: before the start, end, space, escape of one digit; then the frequent ones; escapes of two and four digits.
PAD, END, GAP, ELSE, FIRST, PAIR, RAW = 0, 1, 2, 3, 4, 62, 63
BITS = 6
#: Digits are the symbols from FIRST on; after an escape they can't be taken for others.
DIGITS = (1 << BITS) - FIRST
ESCAPED = {ELSE: 1, PAIR: 2, RAW: 4}
CODES = 0x110000


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


_ZSTD = pa.Codec("zstd", 1)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays that are moved: of each its length, and the planes of its values' bytes, each compressed alone if that is shorter."""
    out = []
    for values in arrays:
        n = len(values)
        out.append(n.to_bytes(8, "little"))
        for plane in np.ascontiguousarray(values.view(np.uint8).reshape(n, values.itemsize).T):
            data = b""
            if plane.any():
                data = _ZSTD.compress(plane, asbytes=True)
                if len(data) >= n:
                    data = plane.tobytes()
            out += [len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unsqueezed(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The first of the arrays, of these kinds."""
    view, at, out = memoryview(data), 0, []
    for kind in kinds:
        n, width = int.from_bytes(view[at : at + 8], "little"), np.dtype(kind).itemsize
        at += 8
        planes = np.zeros((width, n), np.uint8)
        for plane in planes:
            size = int.from_bytes(view[at : at + 8], "little")
            at += 8
            if size:
                part = view[at : at + size]
                plane[:] = np.frombuffer(part if size == n else _ZSTD.decompress(part, n), np.uint8)
                at += size
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Keys as differences, which are small if they ascend; np.cumsum undoes it."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


class Sums:
    """Counts by 64-bit key that are sent on in buckets; ``sent``: those of the last batch."""

    def __init__(self, parts: int, place=None):
        self.parts, self.place, self.held, self.size = parts, place or (lambda keys: keys % np.uint64(parts)), [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.held.append((keys[first], np.diff(np.append(first, len(keys)))))
        self.size += len(first)
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.held = [summed(np.concatenate([k for k, _ in self.held]), np.concatenate([n for _, n in self.held]))]
        self.size = len(self.held[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            self.sent = keys, counts = self.held[0]
            bucket = self.place(keys).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(self.parts + 1))
            some = np.flatnonzero(np.diff(cut))
            yield blobs(some, [keys[order[cut[b] : cut[b + 1]]] for b in some], [counts[order[cut[b] : cut[b + 1]]] for b in some])
            self.held, self.size = [], 0


def blobs(buckets, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([squeezed(steps(k)) for k in keys], pa.binary()), pa.array([squeezed(c.astype(np.int64)) for c in counts], pa.binary())], names=["bucket", "keys", "counts"])


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unsqueezed(keys, np.uint64)[0], dtype=np.uint64), unsqueezed(counts, np.int64)[0]


BLOB = "bucket int, keys binary, counts binary"


def _word_counts(parts: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, chars, docs = Sums(parts), np.zeros(CODES + 1, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for _, _, chunk in chunks(texts_of(batch)):
                codes = lower_ascii(chunk.codes)
                chars += np.bincount(codes, minlength=CODES + 1)
                starts, ends = runs(~white(codes))
                yield from sums.add(chunk.hashes(starts, ends, codes))
        yield from sums.flush()
        # bucket -1: code points, with the number of texts at that of the separator
        some = np.flatnonzero(chars)
        yield blobs([-1], [some.astype(np.uint64)], [chars[some]])

    return f


def _merge_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket, for partitions that each hold one bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    bucket, size = None, 0
    for batch in batches:
        for b, k, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "keys", "counts")), strict=True):
            bucket = b
            held.append(unpacked(k, c))
            size += len(held[-1][0])
            if size > 4 * HELD:
                held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                size = len(held[0][0])
    if held:
        keys, counts = summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        own = blobs([bucket], [keys], [counts])
        yield own.append_column("distinct", pa.array([len(keys)], pa.int64())).append_column("total", pa.array([int(counts.sum())], pa.int64()))


def _hot(least: float):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = unpacked(k, c)
                keep = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    return f


class Alphabet:
    """The spelling of code points, which are given by falling frequency."""

    def __init__(self, ranked: list[int]):
        self.table = np.full(CODES + 1, RAW, np.uint8)
        self.number = np.arange(CODES + 1, dtype=np.int32)
        for escape, rest in ((ELSE, ranked[SYMBOLS:][:DIGITS]), (PAIR, ranked[SYMBOLS + DIGITS :][: DIGITS * DIGITS])):
            self.table[rest] = escape
            self.number[rest] = np.arange(len(rest))
        frequent = ranked[:SYMBOLS]
        self.table[frequent] = FIRST + np.arange(len(frequent))
        self.table[[32, 9, 10, 11, 12, 13]] = GAP
        self.table[SEP] = END
        self.sizes = np.ones(1 << BITS, np.int64)
        for escape, digits in ESCAPED.items():
            self.sizes[escape] += digits

    def spelled(self, chunk: Chunk, codes: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, and where each text's begin."""
        keep = ~white(codes)
        keep[chunk.off[1:] - 1] = True
        inner = np.ones(len(starts), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        keep[starts[inner] - 1] = True
        own = codes[keep]
        symbols = self.table[own]
        sizes = self.sizes[symbols]
        at = np.concatenate(([0], np.cumsum(sizes)))
        begin = at[np.concatenate(([0], np.cumsum(keep)))[chunk.off]]
        if at[-1] == len(symbols):
            return symbols, begin
        out = np.zeros(at[-1], np.uint8)
        out[at[:-1]] = symbols
        for escape, digits in ESCAPED.items():
            some = np.flatnonzero(symbols == escape)
            number = self.number[own[some]]
            for k in range(digits):
                out[at[some] + 1 + k] = FIRST + number // DIGITS ** (digits - 1 - k) % DIGITS
        return out, begin


def contexts(symbols: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Codes of the last 0, 1 ... DEPTH symbols before each symbol, nearest in the lowest bits."""
    out = [np.zeros(len(symbols), np.uint64)]
    for d in range(1, DEPTH + 1):
        back = np.zeros(len(symbols), np.uint64)
        back[d:] = symbols[:-d]
        early = (begin[:-1, None] + np.arange(d)).ravel()  # beyond a shorter text it is the next one that begins
        back[early[early < len(symbols)]] = PAD
        out.append(out[-1] | (back << np.uint64(BITS * (d - 1))))
    return out


#: Where a gram's depth is in its key, above the next symbol and the context.
_DEPTH_AT = np.uint64(BITS * (DEPTH + 1))


def _gram_counts(shared, parts: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet: Alphabet = shared.value
        place = lambda keys: mix(keys >> np.uint64(BITS)) % np.uint64(parts)  # all next symbols of a context together
        full = Sums(parts, place)
        low: list[tuple[np.ndarray, np.ndarray]] = []

        def lower(batch_of: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Grams of the full depth and, summed from them, of the shorter ones."""
            for b in batch_of:
                yield b
                keys, counts = full.sent
                for d in range(DEPTH - 1, -1, -1):
                    keys, counts = summed(np.uint64(d) << _DEPTH_AT | keys & np.uint64((1 << BITS * (d + 1)) - 1), counts)
                    low.append((keys, counts))

        for batch in batches:
            for _, _, chunk in chunks(texts_of(batch)):
                codes = lower_ascii(chunk.codes)
                starts, _ = runs(~white(codes))
                symbols, begin = alphabet.spelled(chunk, codes, starts, chunk.per_text(starts))
                grams = contexts(symbols, begin)[DEPTH] << np.uint64(BITS) | symbols
                yield from lower(full.add(grams | np.uint64(DEPTH) << _DEPTH_AT))
        yield from lower(full.flush())
        if low:
            rest = Sums(parts, place)
            rest.held = low
            yield from rest.flush()

    return f


def _frequent_contexts(least: float):
    """Of one bucket's grams, those of contexts that have at least so many symbols."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merge_counts(batches):
            keys, counts = unpacked(batch.column("keys")[0].as_py(), batch.column("counts")[0].as_py())
            context = keys >> np.uint64(BITS)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            keep = np.repeat(np.add.reduceat(counts, first) >= least, np.diff(np.append(first, len(keys))))
            yield pa.RecordBatch.from_arrays([pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    return f


class Tree:
    """The retained contexts; ``logs``: a row of log10 probabilities of the next symbol for each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: Alphabet):
        self.alphabet = alphabet
        keys, counts = summed(keys, counts)
        depth = (keys >> _DEPTH_AT).astype(np.int64)
        context = keys >> np.uint64(BITS) & np.uint64((1 << BITS * DEPTH) - 1)
        following = (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
        width = 1 << BITS
        root = np.bincount(following[depth == 0], counts[depth == 0], width) + 1.0
        root[[PAD]] = 0.0
        levels: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), (root / root.sum())[None])]
        gains = [np.ones(1)]
        for d in range(1, DEPTH + 1):
            own = depth == d
            at, row = np.unique(context[own], return_inverse=True)
            table = np.zeros((len(at), width))
            np.add.at(table, (row, following[own]), counts[own])
            up, probability = levels[-1]
            parent = probability[np.searchsorted(up, at & np.uint64((1 << BITS * (d - 1)) - 1))] if len(at) else np.zeros((0, width))
            total = table.sum(1, keepdims=True)
            smooth = (table + SMOOTHING * parent) / (total + SMOOTHING)
            with np.errstate(divide="ignore", invalid="ignore"):
                gains.append(np.where(smooth > 0, smooth * np.log(smooth / parent), 0.0).sum(1))
            levels.append((at, smooth))
        keep = [g >= DIVERGENCE for g in gains]
        for d in range(DEPTH, 1, -1):  # the suffixes of states are states
            up = levels[d - 1][0]
            keep[d - 1][np.searchsorted(up, levels[d][0][keep[d]] & np.uint64((1 << BITS * (d - 1)) - 1))] = True
        self.contexts = [at[k] for (at, _), k in zip(levels, keep, strict=True)]
        first = np.cumsum([0] + [len(x) for x in self.contexts])
        self.first = first
        with np.errstate(divide="ignore"):
            self.logs = np.log10(np.concatenate([p[k] for (_, p), k in zip(levels, keep, strict=True)])).astype(np.float32)

    def _direct(self) -> np.ndarray:
        """The deepest state of less than full depth, by the last DEPTH - 1 symbols."""
        if "_states" not in self.__dict__:
            states = np.zeros(1 << BITS * (DEPTH - 1), np.int32)
            for d in range(1, DEPTH):
                states.reshape(-1, 1 << BITS * d)[:, self.contexts[d].astype(np.int64)] = self.first[d] + np.arange(len(self.contexts[d]))
            self._states = states
        return self._states

    def _deepest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each state of one symbol less than full depth a row, 0 if it has none: the states that one symbol before it makes, 0 for none."""
        if "_below" not in self.__dict__:
            full = self.contexts[DEPTH]
            own = self._direct()[(full & np.uint64((1 << BITS * (DEPTH - 1)) - 1)).astype(np.int64)] - self.first[DEPTH - 1]
            up, at = np.unique(own, return_inverse=True)
            row, below = np.zeros(len(self.contexts[DEPTH - 1]), np.int32), np.zeros((len(up) + 1, 1 << BITS), np.int32)
            row[up] = np.arange(1, len(up) + 1)
            below[at + 1, (full >> np.uint64(BITS * (DEPTH - 1))).astype(np.int64)] = self.first[DEPTH] + np.arange(len(full))
            self._row, self._below = row, below
        return self._row, self._below

    def states(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The longest suffix before each symbol that is a state."""
        codes = contexts(symbols, begin)
        out = self._direct()[codes[DEPTH - 1].astype(np.int64)]
        if len(self.contexts[DEPTH]):
            row, below = self._deepest()
            deep = np.flatnonzero(out >= self.first[DEPTH - 1])
            deep = deep[row[out[deep] - self.first[DEPTH - 1]] > 0]
            found = below[row[out[deep] - self.first[DEPTH - 1]], (codes[DEPTH][deep] >> np.uint64(BITS * (DEPTH - 1))).astype(np.int64)]
            out[deep[found > 0]] = found[found > 0]
        return out

    def each(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol."""
        return self.logs[self.states(symbols, begin), symbols].astype(np.float64)


class Model:
    """The tree, the frequent words' counts, and the totals."""

    def __init__(self, tree: Tree, hot: np.ndarray, hot_counts: np.ndarray, ends: int, tokens: int, distinct: int):
        self.tree, self.hot, self.hot_counts, self.ends, self.tokens, self.distinct = tree, hot, hot_counts, ends, tokens, distinct


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the rows' texts, and the table of word counts: a row a bucket, with keys and counts."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    slim = docs.select("text")
    counted = written(slim.mapInArrow(lean(_word_counts(parts)), BLOB), "word-counts")
    chars, ends = np.zeros(CODES + 1, np.int64), 0
    for r in counted.where("bucket = -1").toLocalIterator():  # one row a task, of its distinct code points
        k, c = unpacked(r["keys"], r["counts"])
        chars[k.astype(np.int64)] += c
    ends = int(chars[SEP])
    words = written(counted.where("bucket >= 0").repartitionById(parts, F.col("bucket")).mapInArrow(lean(_merge_counts), BLOB + ", distinct long, total long"), "words")
    sums = words.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    tokens, distinct = int(sums.n or 0) + ends, int(sums.v or 0) + (ends > 0)
    hot = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in words.select("keys", "counts").mapInArrow(lean(_hot(max(HOT_LEAST, HOT * tokens))), "keys binary, counts binary").where(F.length("keys") > 0).collect()]
    hot_keys, hot_counts = summed(np.concatenate([k for k, _ in hot] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in hot] or [np.zeros(0, np.int64)]))
    chars[[9, 10, 11, 12, 13, 32, SEP]] = 0
    alphabet = Alphabet([c for c in np.argsort(-chars, kind="stable")[: SYMBOLS + DIGITS + DIGITS * DIGITS].tolist() if chars[c]])
    symbols = int((chars * alphabet.sizes[alphabet.table]).sum()) + tokens  # an end or a space after each word
    grams = slim.mapInArrow(lean(_gram_counts(spark.sparkContext.broadcast(alphabet), parts)), BLOB)
    kept = grams.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_frequent_contexts(max(2, LEAST * symbols))), "keys binary, counts binary").collect()
    tree = Tree(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in kept] or [np.zeros(0, np.uint64)]), np.concatenate([np.frombuffer(r["counts"], np.int64) for r in kept] or [np.zeros(0, np.int64)]), alphabet)
    return Model(tree, hot_keys, hot_counts, ends, tokens, distinct), words


#: Words of texts whose places are packed together, and such texts at most.
PACK = 1_500_000
TEXTS = 50_000
#: From the home of a task's pack to that of its next one, so that those of many tasks are dealt over all buckets.
STRIDE = 7919
#: A following word is told apart by its number, twice, if it is broadcast (under 2 / HOT), else by this many bits of its hash, with the next one set.
CODE = np.uint64(46)
#: Bits of a broadcast word's code; and the code where no word follows.
HOT_CODE = np.uint64(18)
NONE = (1 << 18) - 1
#: Broadcast words whose sums go in one row.
SLICE = 1024
#: What a text's last word is told apart by from the same word elsewhere: another symbol follows it.
LAST = np.uint64(0x9E3779B97F4A7C15)
ROW = "key long, pieces long, rows binary"
PLACES = "pack long, texts long, trained long, home int, places binary, pairs binary"
SUMS = "pack long, texts long, sums binary"


def _nulls(schema: str, n: int) -> list[pa.Array]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [pa.nulls(n, kinds[c.split()[1]]) for c in schema.split(", ")]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _first_pass(shared, parts: int, states: bool):
    """A pack of texts at a time, a row with what needs no lookup, in the bucket that is the pack's home; and the pack's pieces.

    A piece holds a bucket's places of the other words; with states also those of the broadcast words, by bucket of the
    word and the one that follows. Texts are told apart by the pack and their number in it, learned ones first.
    """

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = ["bucket", *_names(ROW), *_names(PLACES)]

        def packed(home: int, texts: list[tuple[np.ndarray, ...]], places: list[tuple[np.ndarray, ...]], pairs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            own, learned, *values = (np.concatenate(x) for x in zip(*texts, strict=True))
            order = np.argsort(~learned, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            trained = int(learned.sum())
            pack = mix(np.array([(mix(own[order]) * (2 * np.arange(len(order), dtype=np.uint64) + np.uint64(1))).sum() + np.uint64(trained)], np.uint64))
            found = _place_bytes(places, number, parts)
            more = _pair_bytes(pairs, number, trained, parts) if pairs else {}
            some = sorted(found.keys() | more.keys())
            ids, *values = (x[order] for x in values)
            row = [pa.array([home], pa.int32()), pa.array(pack.view(np.int64)), pa.array([len(some)], pa.int64()), pa.array([squeezed(steps(ids.view(np.uint64)), *values)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*row, *_nulls(PLACES, 1)], names=names)
            of = [int(pack.view(np.int64)[0]), len(order), trained, home]
            own = [pa.array([x] * len(some), t) for x, t in zip(of, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *_nulls(ROW, len(some)), *own, *(pa.array([x.get(b) for b in some], pa.binary()) for x in (found, more))], names=names)

        context = TaskContext.get()
        home = context.partitionId() % parts if context else 0
        texts, places, pairs, count, pair_count, before = [], [], [], 0, 0, 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
            trained = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, chunk in chunks(texts_of(batch)):
                codes = lower_ascii(chunk.codes)
                starts, ends = runs(~white(codes))
                first = chunk.per_text(starts)
                hashes = chunk.hashes(starts, ends, codes)
                symbols, begin = m.tree.alphabet.spelled(chunk, codes, starts, first)
                n = np.diff(first)
                each = m.tree.each(symbols, begin)
                scores = np.add.reduceat(each, begin[:-1])
                words = _word_logs(symbols, each, n)
                own = mix(chunk.hashes(chunk.off[:-1], chunk.off[1:] - 1) ^ ids[a:b].view(np.uint64))
                at = np.searchsorted(m.hot, hashes)
                at[at == len(m.hot)] = 0
                there = m.hot[at] == hashes if len(m.hot) else np.zeros(len(hashes), bool)
                logs = np.where(there, np.log10(m.hot_counts + 1.0)[at] if len(m.hot) else 0.0, 0.0)
                known = np.diff(np.concatenate(([0], np.cumsum(there)))[first])
                owner = np.repeat(np.arange(b - a), n)
                sums = np.bincount(owner, logs, b - a)
                texts.append((own, trained[a:b], ids[a:b], n + 1, known + (m.ends > 0), sums + np.log10(m.ends + 1.0), scores))
                last = np.zeros(len(hashes), bool)
                last[first[1:][n > 0] - 1] = True
                code = np.where(there, 2 * at.astype(np.uint64) + last, mix(np.where(last, hashes ^ LAST, hashes)) >> np.uint64(64) - CODE | np.uint64(1) << CODE)
                following, its_log = np.full(len(hashes), NONE, np.uint64), np.zeros(len(hashes), np.float16)
                own_log = _shortened(words)
                inner = np.flatnonzero(~last)
                following[inner] = code[inner + 1]
                its_log[inner] = own_log[inner + 1]
                owner = (owner + before).astype(np.uint32)
                rest = np.flatnonzero(~there)
                places.append((hashes[rest], owner[rest], following[rest], its_log[rest]))
                if states:
                    paired = np.flatnonzero(there & ~last)
                    word, x = at[paired].astype(np.uint64), following[paired]
                    pairs.append((np.where(x < NONE, word << HOT_CODE | x, np.uint64(1 << 63) | word << CODE | x & (np.uint64(1) << CODE) - np.uint64(1)), owner[paired], its_log[paired]))
                    pair_count += len(paired)
                before += b - a
                count += len(rest)
                if count > PACK or pair_count > 2 * PACK or before > TEXTS:
                    yield from packed(home, texts, places, pairs)
                    home = (home + STRIDE) % parts
                    texts, places, pairs, count, pair_count, before = [], [], [], 0, 0, 0
        if texts:
            yield from packed(home, texts, places, pairs)

    return f


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucketed(bucket: np.ndarray, order: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, then as given, and where each bucket begins."""
    own = bucket.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    return order[np.argsort(own[order], kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=parts))))


def _place_bytes(places: list[tuple[np.ndarray, ...]], number: np.ndarray, parts: int) -> dict[int, bytes]:
    """By bucket: distinct words and their places; of these text, following word (by number, then by hash) and its log."""
    words, owners, following, logs = (np.concatenate(x) for x in zip(*places, strict=True))
    places.clear()
    order, cut = _bucketed(words % np.uint64(parts), np.argsort(words), parts)
    words, owners, following, logs = words[order], number[owners[order]], following[order], logs[order]
    first = _firsts(words)
    n, at = np.diff(np.append(first, len(words))).astype(np.uint32), np.searchsorted(first, cut)
    out = {}
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own, mine = slice(cut[b], cut[b + 1]), slice(at[b], at[b + 1])
        x = following[own]
        short = x <= NONE
        out[b] = squeezed(steps(words[first[mine]]), n[mine], owners[own], np.packbits(short), x[short].astype(np.uint32), x[~short], logs[own])
    return out


def _pair_bytes(pairs: list[tuple[np.ndarray, ...]], number: np.ndarray, trained: int, parts: int) -> dict[int, bytes]:
    """By bucket: pairs of two broadcast words, other pairs, their runs, and of these places, training places, log and texts.

    Places of one pair and one log are a run: what is asked of a pair's count is the same for them.
    """
    pair, owners, logs = (np.concatenate(x) for x in zip(*pairs, strict=True))
    pairs.clear()
    order = np.argsort(pair)
    rank = np.zeros(len(order), np.uint64)
    rank[_firsts(pair[order])[1:]] = 1
    order = order[np.argsort(np.cumsum(rank, dtype=np.uint64) << np.uint64(16) | logs[order].view(np.uint16))]
    order, cut = _bucketed(mix(pair) % np.uint64(parts), order, parts)
    pair, owners, logs = pair[order], number[owners[order]], logs[order]
    first = _firsts(pair, logs.view(np.uint16))
    n, at = np.diff(np.append(first, len(pair))).astype(np.uint32), np.searchsorted(first, cut)
    mine = np.add.reduceat(owners < trained, first, dtype=np.uint32) if len(first) else n
    pair, logs = pair[first], logs[first]
    out = {}
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = slice(at[b], at[b + 1])
        x = pair[own]
        k = np.searchsorted(x, np.uint64(1 << 63))
        out[b] = squeezed(steps(x[:k]), steps(x[k:]), n[own], mine[own], logs[own], owners[cut[b] : cut[b + 1]])
    return out


def _pair_words(pairs: np.ndarray) -> np.ndarray:
    """The broadcast words that pairs begin with."""
    return np.where(pairs >> np.uint64(63), pairs << np.uint64(1) >> CODE + np.uint64(1), pairs >> HOT_CODE).astype(np.int64)


def _shortened(logs: np.ndarray) -> np.ndarray:
    """Logarithms in two bytes, rounded up, so that no state gives a word more than it has."""
    out = np.maximum(logs, -60000.0).astype(np.float16)
    return np.where(out < logs, np.nextafter(out, np.float16(0)), out)


def _word_logs(symbols: np.ndarray, each: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the log10 probability of its symbols and of the space or end after it; n: words by text."""
    stop = np.flatnonzero((symbols == GAP) | (symbols == END))
    if not len(stop):
        return np.zeros(0)
    sums = np.add.reduceat(each, np.concatenate(([0], stop[:-1] + 1)))
    return sums[np.repeat(n > 0, np.maximum(n, 1))]  # a text without words is its end alone


def _log_ratio(count, log, total, distinct) -> np.ndarray:
    """The logarithm of a following word's probability in a state over that in the shorter suffix, which is log."""
    weight = np.maximum(distinct, 1.0)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count) - log, np.log(weight)) - np.log(total + weight)


def word_state_gains(word: np.ndarray, following: np.ndarray, logs: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """For each place of a context word, what its state adds to the log10 probability of the following word.

    A word that training places show at least twice is a state if its distribution diverges from the shorter
    suffixes' by ``DIVERGENCE`` nats: the mean, over its training places, of the log ratio of the two probabilities of the
    following word, each place left out of the counts that are asked for it. So words after which nothing recurs are none.
    The shorter suffixes' probability weighs as much in a state as the number of its distinct following words.
    """
    if not len(word):
        return np.zeros(0)
    order = np.lexsort((following, word))
    w, x = word[order], following[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1]))))
    pair = np.empty(len(order), np.int64)
    pair[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
    count = np.bincount(pair, learned)[pair]
    total = np.bincount(word, learned)
    followers = np.bincount(w[first], count[order][first] > 0, len(total))
    log = logs.astype(np.float64) * np.log(10)

    at = np.flatnonzero(learned)
    divergence = np.bincount(word[at], _log_ratio(count[at] - 1.0, log[at], total[word[at]] - 1.0, followers[word[at]] - (count[at] == 1)), len(total)) / np.maximum(total, 1)
    state = (total >= 2) & (divergence >= DIVERGENCE)
    out = np.zeros(len(word))
    at = np.flatnonzero(state[word])
    out[at] = _log_ratio(count[at], log[at], total[word[at]], followers[word[at]]) / np.log(10)
    return out


class Pairs:
    """The places of a bucket's pairs, each of a broadcast word and the word that follows it, in their runs."""

    def __init__(self):
        self.held: list[bytes | None] = []

    def add(self, batch: pa.RecordBatch) -> Pairs:
        self.held += batch.column("pairs").drop_null().to_pylist()
        return self

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each pack: pair, places, training places and log of each run."""
        return (_pair_runs(data) for data in self.held)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, ascending, and their training places."""
        pair, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size, some = 0, []
        for own, _, mine, _ in self.runs():
            some.append((own, mine))
            size += len(own)
            if size > 4 * HELD:
                pair, count = summed(np.concatenate([pair, *(x for x, _ in some)]), np.concatenate([count, *(x for _, x in some)]))
                size, some = 0, []
        return summed(np.concatenate([pair, *(x for x, _ in some)]), np.concatenate([count, *(x for _, x in some)]))


def _pair_runs(data: bytes) -> tuple[np.ndarray, ...]:
    short, long, n, mine, logs = unsqueezed(data, np.uint64, np.uint64, np.uint32, np.uint32, np.float16)
    return np.concatenate([np.cumsum(short, dtype=np.uint64), np.cumsum(long, dtype=np.uint64)]), n.astype(np.int64), mine.astype(np.int64), logs.astype(np.float64) * np.log(10)


def _slices(sums: np.ndarray) -> pa.RecordBatch:
    """Sums by broadcast word (a row of them for each kind), cut into rows by word."""
    kinds, n = sums.shape
    wide = np.zeros((kinds, -(-n // SLICE) * SLICE))
    wide[:, :n] = sums
    cut = [np.ascontiguousarray(x).tobytes() for x in np.split(wide, wide.shape[1] // SLICE, 1)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["slice", "data"])


def _pair_totals(hot: int):
    """By broadcast word: its training places that a word follows, and the distinct words that follow it in them."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs()
        for batch in batches:
            pairs.add(batch)
        pair, count = pairs.counts()
        if len(pair):
            word = _pair_words(pair)
            yield _slices(np.stack([np.bincount(word, count, hot), np.bincount(word, count > 0, hot)]))

    return f


def _pair_divergence(hot: int):
    """By broadcast word: the log ratios of ``word_state_gains`` summed over its training places; totals come with the bucket's mark."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, marks = Pairs(), None
        for batch in batches:
            pairs.add(batch)
            marks = _mark(batch, "totals", marks)
        if pairs.held:
            total, followers = np.frombuffer(marks).reshape(2, hot)
            keys, counts = pairs.counts()
            sums = np.zeros(hot)
            for pair, _, mine, log in pairs.runs():
                some = np.flatnonzero(mine)
                pair, mine = pair[some], mine[some]
                count, word = counts[np.searchsorted(keys, pair)], _pair_words(pair)
                sums += np.bincount(word, mine * _log_ratio(count - 1.0, log[some], total[word] - 1.0, followers[word] - (count == 1)), hot)
            yield _slices(sums[None])

    return f


def _mark(batch: pa.RecordBatch, column: str, before: bytes | None) -> bytes | None:
    own = batch.column(column).drop_null()
    return own[0].as_py() if len(own) else before


def _sum_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one slice, for partitions that each hold one."""
    own, sums = None, 0.0
    for batch in batches:
        for own, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist(), strict=True):
            sums = sums + np.frombuffer(data)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["slice", "data"])


def _join_slices(hot: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: np.frombuffer(d).reshape(-1, SLICE) for b in batches for s, d in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True)}
        if held:
            whole = np.concatenate([held[s] for s in sorted(held)], 1)[:, :hot]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(whole).tobytes()], pa.binary())], names=["data"])

    return f


def _marked(met: DataFrame, sums: DataFrame, hot: int, name: str) -> DataFrame:
    """met, with the sums over all buckets, in one row, at the mark of each bucket."""
    n = -(-hot // SLICE)
    each = sums.repartitionById(n, F.col("slice")).mapInArrow(lean(_sum_slices), "slice int, data binary")
    one = each.repartition(1).mapInArrow(lean(_join_slices(hot)), f"{name} binary").withColumn("late", F.lit(-1))
    return met.join(F.broadcast(one), "late", "left")


def _pair_gains(pairs: Pairs, totals: bytes, divergence: bytes):
    """What the states of broadcast words add to the log10 probability of each place of a piece's pairs: ``word_state_gains`` by pairs."""
    divergence = np.frombuffer(divergence)
    total, followers = np.frombuffer(totals).reshape(2, -1)
    state = (total >= 2) & (divergence >= DIVERGENCE * np.maximum(total, 1))
    keys, counts = pairs.counts()

    def gains(data: bytes) -> np.ndarray:
        pair, n, _, log = _pair_runs(data)
        word = _pair_words(pair)
        some = np.flatnonzero(state[word])
        gain = np.zeros(len(pair))
        word = word[some]
        gain[some] = _log_ratio(counts[np.searchsorted(keys, pair[some])].astype(np.float64), log[some], total[word], followers[word]) / np.log(10)
        return np.repeat(gain, n)

    return gains


class Piece:
    """A bucket's places of the texts of one pack; of the words that are not broadcast only what is asked of them."""

    def __init__(self, pack: int, texts: int, trained: int, home: int, places: bytes | None, pairs: bytes | None, keys: np.ndarray, counts: np.ndarray):
        self.pack, self.texts, self.home, self.pairs = pack, texts, home, pairs
        words, n, self.at, short, numbers, hashes, logs = unsqueezed(places, np.uint64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint64, np.float16) if places else (np.zeros(0, k) for k in (np.uint64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint64, np.float16))
        words = np.cumsum(words, dtype=np.uint64)
        place = np.searchsorted(keys, words)
        place[place == len(keys)] = 0
        found = np.where(keys[place] == words, counts[place], 0) if len(keys) else np.zeros(len(words), np.int64)
        self.found, self.n = found, n
        short = np.unpackbits(short, count=len(self.at)).astype(bool)
        following = np.empty(len(self.at), np.uint64)
        following[short], following[~short] = numbers, hashes
        self.some = np.flatnonzero((np.repeat(found, n) > 1) & (following != NONE))
        self.states = np.repeat(place.astype(np.int32), n)[self.some], following[self.some], logs[self.some], (self.at < trained)[self.some]

    def sums(self, gains: np.ndarray, pair_gains) -> bytes:
        """By text known words, their logs of counts and what states add, of the texts that have any."""
        known = np.bincount(self.at, np.repeat(self.found > 0, self.n), self.texts)
        base = np.bincount(self.at, np.repeat(np.log10(self.found + 1.0), self.n), self.texts)
        score = np.bincount(self.at[self.some], gains, self.texts)
        if self.pairs is not None:
            at = unsqueezed(self.pairs, np.uint64, np.uint64, np.uint32, np.uint32, np.float16, np.uint32)[-1]
            score += np.bincount(at, pair_gains(self.pairs), self.texts)
        some = (known > 0) | (score != 0)
        return squeezed(np.packbits(some), known[some].astype(np.uint32), base[some], score[some].astype(np.float32))


def _second_pass(parts: int, paired: bool):
    """A bucket's word counts (first in its partition) meet its places; sums by text, a row a piece, go to the pack's home."""

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pieces: list[Piece] = []
        pairs, totals, divergence = Pairs(), None, None
        names = ["bucket", *_names(ROW), *_names(SUMS)]
        for batch in batches:
            if paired:
                totals, divergence = _mark(batch, "totals", totals), _mark(batch, "divergence", divergence)
            rows = batch.filter(batch.column("key").is_valid())
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in ["bucket", *_names(ROW)]] + _nulls(SUMS, rows.num_rows), names=names)
            batch = batch.filter(pc.or_(batch.column("keys").is_valid(), batch.column("pack").is_valid()))
            for k, c, *piece in zip(*(batch.column(n).to_pylist() for n in ["keys", "counts", *_names(PLACES)]), strict=True):
                if k is not None:
                    keys, counts = unpacked(k, c)
                    continue
                pieces.append(Piece(*piece, keys, counts))
        if pieces:
            pairs.held = [p.pairs for p in pieces if p.pairs is not None]
            gains = word_state_gains(*(np.concatenate(c) for c in zip(*(p.states for p in pieces), strict=True)))
            pair_gains = _pair_gains(pairs, totals, divergence) if pairs.held else None
            cut = np.cumsum([0] + [len(p.some) for p in pieces])
            sums = [p.sums(gains[a:b], pair_gains) for p, a, b in zip(pieces, cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p.home for p in pieces], pa.int32()), *_nulls(ROW, len(pieces)), pa.array([p.pack for p in pieces], pa.int64()), pa.array([p.texts for p in pieces], pa.int64()), pa.array(sums, pa.binary())], names=names)

    return f


def _sum_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of one bucket's packs, with their sums; packs that are alike share what all have gathered."""
    rows, held = [], {}
    for batch in batches:
        own = batch.filter(batch.column("key").is_valid())
        rows += zip(*(own.column(c).to_pylist() for c in _names(ROW)), strict=True)
        own = batch.filter(batch.column("pack").is_valid())
        for pack, n, data in zip(*(own.column(c).to_pylist() for c in _names(SUMS)), strict=True):
            come, sums = held.setdefault(pack, (0, np.zeros((3, n))))
            some, *values = unsqueezed(data, np.uint8, np.uint32, np.float64, np.float32)
            at = np.flatnonzero(np.unpackbits(some, count=n))
            for total, x in zip(sums, values, strict=True):
                total[at] += x
            held[pack] = come + 1, sums
    alike = Counter(key for key, _, _ in rows)
    for key, pieces, data in rows:
        come, sums = held.get(key, (0, np.zeros((3, 1))))
        if come != pieces * alike[key]:
            raise RuntimeError(f"{come} of {pieces * alike[key]} pieces of a pack came back: its rows came in another order when a task was repeated")
        ids, n, known, base, score = unsqueezed(data, np.uint64, np.int64, np.int64, np.float64, np.float64)
        more = sums / alike[key]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.cumsum(ids, dtype=np.uint64).view(np.int64), n, known + np.rint(more[0]).astype(np.int64), base + more[1], score + more[2])], names=["doc_id", "n_tokens", "n_known", "base", "score"])


def score(docs: DataFrame, model: Model, words: DataFrame, learned: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``learned`` tells which rows the states of whole words are learned from; without it there are none. To score
    other texts, add the training rows to them, tell them apart by it, and drop their scores.
    """
    spark, parts = docs.sparkSession, parts_for(docs)
    shared = spark.sparkContext.broadcast(model)
    flag = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), flag.alias("learned"))
    hot = len(model.hot) if learned is not None else 0
    first = slim.mapInArrow(lean(_first_pass(shared, parts, hot > 0)), f"bucket int, {ROW}, {PLACES}").withColumn("late", F.lit(1))
    counts = words.select("bucket", "keys", "counts", F.lit(0).alias("late"))
    if hot:
        marks = spark.range(0, parts, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(-1).alias("late"))
        counts = counts.unionByName(marks, allowMissingColumns=True)
    met = counts.unionByName(first, allowMissingColumns=True).repartitionById(parts, F.col("bucket"))
    if hot:  # all three read the one exchange; each takes all its columns, without which Spark would make several
        marked = _marked(met, met.mapInArrow(lean(_pair_totals(hot)), "slice int, data binary"), hot, "totals")
        met = _marked(marked, marked.mapInArrow(lean(_pair_divergence(hot)), "slice int, data binary"), hot, "divergence")
    summed_up = met.sortWithinPartitions("late").mapInArrow(lean(_second_pass(parts, hot > 0)), f"bucket int, {ROW}, {SUMS}").repartitionById(parts, F.col("bucket"))
    each = summed_up.mapInArrow(lean(_sum_texts), "doc_id long, n_tokens long, n_known long, base double, score double")
    all_ = float(np.log10(model.tokens + model.distinct + 1))
    return each.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(all_)).alias("base_score"), "score")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, words = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, words, ~held_out(F.col("doc_id"))).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
