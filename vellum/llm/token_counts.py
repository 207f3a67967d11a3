"""Token counts: pieces are counted once per distinct pre-token, joined to the pre-token frequencies of each document, and summed; no ids are made for a document.

A block of documents becomes the frequencies of its (document, pre-token) pairs; its distinct pre-tokens that a
worker's table of counts doesn't have are encoded, once each, and only their numbers of pieces are kept; then the
frequencies are joined to the table and summed by document. The table lives as long as the worker works on the
query (``MEMO`` entries at most, then begun anew), so a pre-token is encoded once a worker. Nothing is shuffled: the
same join over the whole corpus, which would encode it once, is not built; the README has what it would move.

Defined results: null and empty texts have 0 tokens; a text that holds one of the tokenizer's special strings
is encoded whole by the library, which makes one token of it; repeated rows are each counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, packed_row, row_schema, stage_cache, table, texts_of
from .pretokens import MEMO, Splitter, byte_level, tokenizer
from .vectext import Chunk, Numbers, chunks


class Table:
    """How many pieces each distinct pre-token has; no ids."""

    def __init__(self, library: Tokenizer, limit: int = MEMO):
        self.encode, self.limit, self.numbers = library.model.tokenize, limit, Numbers()
        self.clear()

    def clear(self) -> None:
        self.numbers.clear()
        self.counts = np.zeros(0, np.int32)

    def rows(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each span its row in ``counts``; the pieces of a distinct pre-token that has none are counted, once."""
        hashes = chunk.hashes(starts, ends)
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
        pieces = (len(self.encode(byte_level(chunk.text(a, b)))) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True))
        self.counts = np.concatenate((self.counts, np.fromiter(pieces, np.int32, len(where))))
        return found


def frequencies(chunk: Chunk, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (document, pre-token) pairs of a block and their frequencies: documents, rows of the table, frequencies."""
    width = int(rows.max()) + 1
    document = np.searchsorted(chunk.off, starts, "right") - 1
    pairs, frequency = np.unique(document * width + rows, return_counts=True)
    return pairs // width, pairs % width, frequency


class Counter:
    """Counts the tokens of texts as one byte-level tokenizer file gives them."""

    def __init__(self, name: str):
        self.library = tokenizer(name)
        self.split, self.table = Splitter(self.library, gaps=True), Table(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b, chunk in chunks(texts):
            starts, ends = self.split.spans(chunk.codes)
            if len(starts):
                document, row, frequency = frequencies(chunk, starts, self.table.rows(chunk, starts, ends))
                out[a:b] = np.bincount(document, frequency * self.table.counts[row], b - a).astype(np.int64)
        for i, x in enumerate(texts):
            if any(s in x for s in self.special):
                out[i] = self.whole(x)
        return out


_counters: dict[str, Counter] = stage_cache()


def _count(name: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(name) or _counters.setdefault(name, Counter(name))
        for batch in batches:
            texts = texts_of(batch)
            n_bytes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_bytes), pa.array(counter.counts(texts))], names=["row", "n_bytes", "n_tokens"])

    return f


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer_file: str = "byte_bpe_50k.json") -> DataFrame:
    """The kept columns of each row, n_bytes (UTF-8) and n_tokens of its whole text."""
    rows = docs.select(packed_row(keep).alias("row"), F.col(text).alias("text"))
    out = rows.mapInArrow(lean(_count(tokenizer_file)), row_schema(rows.select("row"), "n_bytes long, n_tokens long"))
    return out.select("row.*", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > limit)
