"""Pre-tokens of byte-pair tokenizers for whole chunks of texts, and what each distinct pre-token encodes to.

The two split patterns are evaluated as operations on arrays of character classes. Code points from U+0250
on are classified by asking the tokenizer's own pre-tokenizer, once each, so the classes are the library's.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .vectext import SEP, Chunk, Numbers

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 5
#: Below this all classes are fixed by old versions of Unicode.
PLAIN = 0x250
#: Distinct pre-tokens that a worker remembers before it starts anew: some 100 MB.
MEMO = 1_500_000


def tokenizer(name: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(public_tokenizers.path(name))


def _plain_classes() -> np.ndarray:
    table = np.zeros(SEP + 1, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    table[SEP] = END
    return table


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def byte_level(text: str) -> str:
    return text.encode().decode("latin1").translate(byte_letters())


class Splitter:
    """Splits chunks as one tokenizer does; ``gaps``: a pre-token takes the space before it, and white space counts."""

    def __init__(self, library: Tokenizer, gaps: bool):
        self.library, self.gaps, self.table = library, gaps, _plain_classes()

    def _ask(self, code: int) -> int:
        c, split = chr(code), self.library.pre_tokenizer.pre_tokenize_str
        for kind, around in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(around + c + around)) == 1:
                return kind
        return SPACE

    def classes(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if not found.all():
            for c in np.unique(codes[found == 0]).tolist():
                self.table[c] = self._ask(c)
            found = self.table[codes]
        return found

    def spans(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pre-tokens; no span reaches over the end of a text."""
        kind = self.classes(codes)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        at = np.arange(len(codes))
        if self.gaps:
            # the last white space before anything else stands alone, or goes with what follows if it is a space
            last = at[:-1][(kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)]
            cut[last] = True
            cut[last[codes[last] == 32] + 1] = False
        else:
            cut[:-1] |= kind == NUMBER
        cut[:-1] |= kind == END
        # an apostrophe that a pre-token begins with, alone before letters that it belongs to
        quote = at[codes == 39]
        quote = quote[cut[quote] & cut[quote + 1]]
        after = np.concatenate((codes, np.full(3, SEP, np.uint32)))
        one, two = after[quote + 1], after[quote + 2]
        short = np.isin(one, [115, 116, 109, 100])
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for which, n in ((short, 1), (long & ~short, 2)):
            q = quote[which]
            cut[q + 1] = False
            rest = q[kind[np.minimum(q + n + 1, len(kind) - 1)] == LETTER]
            cut[rest + n + 1] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != END
        if not self.gaps:
            keep &= kind[starts] != SPACE
        return starts[keep], ends[keep]


class Memo:
    """Each distinct pre-token is encoded once; values are token ids in a row."""

    def __init__(self, library: Tokenizer, limit: int = MEMO):
        self.encode, self.limit, self.numbers = library.model.tokenize, limit, Numbers()
        self.clear()

    def clear(self) -> None:
        self.numbers.clear()
        self.first = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def rows(self, chunk: Chunk, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each span its row in ``first`` and ``lengths``."""
        hashes = chunk.hashes(starts, ends, codes)
        found = self.numbers.find(hashes)
        if found.min() >= 0:
            return found
        if len(self.numbers) > self.limit:
            self.clear()
            found[:] = -1
        missing = np.flatnonzero(found < 0)
        fresh, where, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        found[missing] = len(self.numbers) + which
        self.numbers.add(fresh)
        where = missing[where]
        ids = [[t.id for t in self.encode(byte_level(codes[a:b].tobytes().decode("utf-32-le")))] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, np.fromiter((t for x in ids for t in x), np.uint32, int(lengths.sum()))))
        return found
