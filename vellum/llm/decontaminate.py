"""Benchmark decontamination: a broadcast hash set of benchmark word n-grams scans the texts.

Benchmark items become windows of ``N`` words (an item of fewer words, but not none, is one window). Each
text's words become numbers of the benchmark's vocabulary, windows of them are looked up by hash, and every
hit is verified by its full words. The windows are broadcast in blocks of at most ``BLOCK_WINDOWS``
(window, item) pairs, so what is broadcast is bounded whatever the benchmark's size: a larger benchmark
takes one scan a block, and each document carries its hits from scan to scan.

Defined results: a null or empty text has no words and no hits; null items and items without words have no
windows; the windows of items without an id are hit, but name no item; repeated rows are each answered; columns that are not asked for pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, packed_row, row_schema, table, texts_of, written
from .vectext import SEP, Chunk, chunks, hash_text, lookup, lower_ascii, runs, window_hashes

#: Words of a window.
N = 10
#: (window, item) pairs that are broadcast at once: under 100 MB of words.
BLOCK_WINDOWS = 250_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """The distinct (words, item) pairs of an items table, words joined by single spaces."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    listed = items.select(F.col(item_id).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(N - 1), F.lit(1)))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, N), " "))).alias("words")).distinct()


class Index:
    """The windows of one block, ready to scan texts."""

    def __init__(self, pairs: list[tuple[str, str]]):
        vocabulary: dict[str, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for words, item in pairs:
            key = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words.split(" "))
            self.items.setdefault(key, []).append(item)
        found = sorted((hash_text(w), number) for w, number in vocabulary.items())
        self.hashes = np.array([h for h, _ in found], np.uint64)
        self.numbers = np.array([n for _, n in found], np.uint64)
        self.words = {hash_text(w): w for w in vocabulary}
        self.spelled = {number: w for w, number in vocabulary.items()}
        self.grams = {n: np.unique(window_hashes(np.array([k for k in self.items if len(k) == n], np.uint64).ravel(), n)[::n]) for n in {len(k) for k in self.items}}

    def hits(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, codes: np.ndarray) -> list[list[tuple[int, int, list[str]]]]:
        """For each text the windows found: first word, number of words, items."""
        out: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(first) - 1)]
        at, there = lookup(self.hashes, chunk.hashes(starts, ends, codes))
        ids = np.where(there, self.numbers[at] if len(self.numbers) else 0, 0).astype(np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, grams in self.grams.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)  # all words are in the vocabulary
            if not len(at):
                continue
            at = at[lookup(grams, window_hashes(ids, n)[at])[1]]
            text = np.searchsorted(first, at, "right") - 1
            for i, t in zip(at.tolist(), text.tolist(), strict=True):
                if i + n > first[t + 1]:
                    continue
                key = tuple(ids[i : i + n].tolist())
                items = self.items.get(key)
                if items and all(spelled(codes, starts[i + j], ends[i + j]) == self.spelled[k] for j, k in enumerate(key)):
                    out[t].append((i - int(first[t]), n, items))
        return out


def spelled(codes: np.ndarray, start: int, end: int) -> str:
    return codes[start:end].tobytes().decode("utf-32-le", "surrogatepass")


def words_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, where each text's words begin, and the lower-cased code points."""
    codes = lower_ascii(chunk.codes)
    starts, ends = runs((((codes - np.uint32(48)) < 10) | ((codes - np.uint32(97)) < 26) | (codes >= 128)) & (codes != SEP))
    return starts, ends, chunk.per_text(starts), codes


def _scan(index_of):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            rows: list[tuple] = []
            before = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)
            for _, _, chunk in chunks(texts_of(batch)):
                starts, ends, first, codes = words_of(chunk)
                for t, found in enumerate(index.hits(chunk, starts, ends, first, codes)):
                    lo, hi = int(first[t]), int(first[t + 1])
                    spans, items = next(before)
                    for i, n, its in found:
                        items.extend(x for x in its if x is not None)
                        spans.append({"start": i, "end": i + n, "from": int(starts[lo + i] - chunk.off[t]), "to": int(ends[lo + i + n - 1] - chunk.off[t])})
                    rows.append((hi - lo, united(spans), sorted(set(items))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), SPANS, pa.list_(pa.string()))))], names=["row", "text", "n_words", "hit_spans", "hit_items"])

    return f


SPANS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "from", "to")]))


def united(spans: list[dict]) -> list[dict]:
    """Overlapping or adjacent spans as one, ascending."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] |= {k: max(out[-1][k], s[k]) for k in ("end", "to")}
        else:
            out.append(dict(s))
    return out


def scan(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Each row of docs as struct ``row`` (of the columns to keep, or all), with text, n_words, hit_spans (united; in words and in characters) and hit_items (sorted).

    One pass over the texts for each block of windows; between blocks the rows are written to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    windows = written(benchmark_windows(items, item_id, item_text), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    row = packed_row(keep or docs.columns)
    spans = "array<struct<start:long,end:long,from:long,to:long>>"
    out = docs.select(row.alias("row"), F.col(text).alias("text"), F.array().cast(spans).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    schema = row_schema(out.select("row"), f"text string, n_words long, hit_spans {spans}, hit_items array<string>")
    for b in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r.words, r.item) for r in mine.collect()]))
        out = (written(out, "scanned") if b else out).mapInArrow(lean(_scan(index)), schema)
    return out


def report(docs: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return scan(docs, items, ["doc_id"], **kwargs).select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents") -> DataFrame:
    """The rows of docs, all columns, without contaminated documents, or without the spans that were hit.

    remove: ``documents`` drops each document with a hit; ``spans`` cuts the characters from the first to the
    last word of each united span, and the other columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    found = scan(docs, items)
    if remove == "documents":
        return found.where(F.size("hit_spans") == 0).select("row.*")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, to: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (to - a["at"]).cast("int")))
    cut = F.aggregate("hit_spans", start, lambda a, s: F.struct(s["to"].alias("at"), piece(a, s["from"]).alias("out")), lambda a: piece(a, F.length("text")))
    return found.withColumn("row", F.col("row").withField("text", F.when(F.size("hit_spans") > 0, cut).otherwise(F.col("text")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
