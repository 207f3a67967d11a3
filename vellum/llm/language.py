"""Language identification of spans: script ranges narrow the candidates, and a Viterbi over per-word scores with a switching penalty labels the words.

A word's score under a language is the sum of the log probabilities of its letter trigrams (with its edges)
in a hashed table. Languages that are written in a word's script are its candidates. The best path through
all words of a text pays ``PENALTY`` for each switch; equal neighbours form the spans. A text's language has
the most letters in its spans, and the score is that share of its letters.

The tables are counted over training rows, of which each language has ``TRAIN_DOCS`` at most in expectation,
sampled by a hash of their id and text; a language of fewer rows is counted whole, and every non-null value that
occurs is learned. Texts, and nothing else of a row, are looked at. The model grows with the languages.

Defined results: a null text, or one without letters, is ``und`` with score 0; without any training row every
text is ``und``; ties go to the language first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, packed_row, row_schema, table, texts_of
from .letters import letter_words
from .vectext import SEP, chunks, mix, ragged

TRAIN_DOCS = 20_000
BINS = 1 << 16
PENALTY = 12.0
UNDETERMINED = "und"
#: Word scores that are held at once.
CELLS = 4_000_000
#: First code points of script ranges and the scripts (fixed values).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([c for c, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def scripts_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FIRST, codes, "right") - 1]


def trigrams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of the trigram around each letter, letters of all words in a row; letters of each word."""
    sizes = ends - starts
    at = ragged(starts, sizes)
    first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
    wide = np.concatenate((codes, [SEP])).astype(np.uint64)
    before, own, after = wide[at - 1], wide[at], wide[at + 1]
    before[first] = after[last] = 0
    return (mix((before << np.uint64(42)) | (own << np.uint64(21)) | after) % np.uint64(BINS)).astype(np.int64), sizes


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: language by bin; scripts: language by script, in letters."""
        self.languages = languages
        smooth = counts + 0.1
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)) if languages else np.zeros((BINS, 0), np.float32)
        used = scripts >= 0.005 * np.maximum(scripts.sum(1, keepdims=True), 1) if languages else scripts > 0
        self.barred = (~used.T & used.any(0)[:, None]).astype(np.float32) * np.float32(-1e4)

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        bins, sizes = trigrams(codes, starts, ends)
        out = np.add.reduceat(self.table[bins], np.cumsum(sizes) - sizes, axis=0)
        return out + self.barred[scripts_of(codes[starts])]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The label of each word on the best path of its text; text i has rows first[i] to first[i + 1].

    All texts advance together, word by word. A text whose best single label loses no more than one switch
    costs against the best label of every word needs no path: no switch can pay.
    """
    labels = np.zeros(len(scores), np.uint8 if scores.shape[1] < 256 else np.uint16)
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    if not len(some):
        return labels
    total = np.add.reduceat(scores.astype(np.float64), first[some], axis=0)
    single = total.argmax(1)
    labels[:] = np.repeat(single, sizes[some])
    open_ = some[np.add.reduceat(scores.max(1).astype(np.float64), first[some]) - total.max(1) > penalty]
    if not len(open_):
        return labels
    order = open_[np.argsort(-sizes[open_], kind="stable")]
    begin, size = first[order], sizes[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # texts with more than t words
    own = np.arange(scores.shape[1], dtype=labels.dtype)
    best = scores[begin].astype(np.float64)
    back = np.zeros(scores.shape, labels.dtype)
    for t in range(1, int(size[0])):
        n = active[t]
        rows = begin[:n] + t
        now = best[:n]
        top, arg = now.max(1), now.argmax(1).astype(labels.dtype)
        stay = now >= (top - penalty)[:, None]
        back[rows] = np.where(stay, own, arg[:, None])
        best[:n] = np.where(stay, now, (top - penalty)[:, None]) + scores[rows]
    state = best.argmax(1).astype(labels.dtype)
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        rows = begin[:n] + t
        labels[rows] = state[:n]
        state[:n] = back[rows, state[:n]] if t else state[:n]
    return labels


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(languages)
        counts, scripts = np.zeros((n, BINS), np.int64), np.zeros((n, len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for a, b, chunk in chunks(texts):
                codes, starts, ends, first = letter_words(chunk)
                k = np.repeat(np.array([index.get(x, -1) for x in langs[a:b]], np.int64), np.diff(first))
                starts, ends, k = starts[k >= 0], ends[k >= 0], k[k >= 0]
                if len(starts):
                    bins, sizes = trigrams(codes, starts, ends)
                    counts += np.bincount(np.repeat(k, sizes) * BINS + bins, minlength=n * BINS).reshape(n, BINS)
                    scripts += np.bincount(k * len(SCRIPT_NAMES) + scripts_of(codes[starts]), sizes, n * len(SCRIPT_NAMES)).astype(np.int64).reshape(n, -1)
        both = np.concatenate((counts, scripts), 1)
        k, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(both[k, b])], names=["k", "bin", "n"])

    return f


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of rows with text and language, of each language train_docs at most in expectation; its size is languages x bins."""
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    seen = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(seen)
    sample = rows
    if large := [(x, int(1_000_000 * train_docs / n)) for x, n in seen.items() if n > train_docs]:
        least = F.broadcast(rows.sparkSession.createDataFrame(large, "lang string, below int"))
        sample = rows.join(least, "lang", "left").where(F.col("below").isNull() | (F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < F.col("below")))
    counts, scripts = np.zeros((len(languages), BINS)), np.zeros((len(languages), len(SCRIPT_NAMES)))
    if languages:
        for r in sample.select("text", "lang").mapInArrow(lean(_count(languages)), "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
            (counts if r.bin < BINS else scripts)[r.k, r.bin % BINS if r.bin < BINS else r.bin - BINS] = r.n
    return Model(languages, counts, scripts)


def _groups(texts: list[str], languages: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(texts):
        cells = (len(x) // 4 + 1) * languages
        if size and size + cells > CELLS:
            yield start, i
            start, size = i, 0
        size += cells
    if start < len(texts):
        yield start, len(texts)


def _label(shared, spans: bool):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n = len(model.languages)
        for batch in batches:
            texts = texts_of(batch)
            pred: list[str] = []
            share: list[float] = []
            found: list[list[dict]] = []
            for lo, hi in _groups(texts, max(n, 1)):
                scores, sizes, lengths, places = [], [], [], []
                for _, _, chunk in chunks(texts[lo:hi]):
                    codes, starts, ends, first = letter_words(chunk)
                    if n and len(starts):
                        scores.append(model.word_scores(codes, starts, ends))
                    sizes.append(np.diff(first))
                    lengths.append(ends - starts)
                    if spans:
                        places.append(starts - np.repeat(chunk.off[:-1], np.diff(first)))
                first = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
                length = np.concatenate(lengths)
                if n and len(length):
                    labels = viterbi(np.concatenate(scores), first)
                    place = np.concatenate(places) if spans else None
                    letters = np.bincount(np.repeat(np.arange(hi - lo), np.diff(first)) * n + labels, length, (hi - lo) * n).reshape(-1, n)
                    top, all_ = letters.argmax(1), letters.sum(1)
                    for i in range(hi - lo):
                        a, b = first[i], first[i + 1]
                        pred.append(model.languages[top[i]] if b > a else UNDETERMINED)
                        share.append(float(letters[i, top[i]] / all_[i]) if b > a else 0.0)
                        if spans:
                            cut = np.concatenate(([0], np.flatnonzero(np.diff(labels[a:b])) + 1, [b - a])) if b > a else [0]
                            found.append([{"start": int(place[a + x]), "end": int(place[a + y - 1] + length[a + y - 1]), "lang": model.languages[labels[a + x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)])
                else:
                    pred += [UNDETERMINED] * (hi - lo)
                    share += [0.0] * (hi - lo)
                    found += [[] for _ in range(hi - lo)]
            columns = [batch.column("row"), pa.array(pred, pa.string()), pa.array(share, pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "spans"][: len(columns)])

    return f


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", spans: bool = False) -> DataFrame:
    """Each row as struct ``row`` (of the columns to keep, or all) with lang_pred, score and, if wanted, the labelled spans (in characters)."""
    rows = docs.select(packed_row(keep or docs.columns).alias("row"), F.col(text).alias("text"))
    schema = row_schema(rows.select("row"), "lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans)
    return rows.mapInArrow(lean(_label(docs.sparkSession.sparkContext.broadcast(model), spans)), schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Model:
    """A model of the documents that are not held out."""
    return train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs), ["doc_id"])
    return out.select("row.doc_id", F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
