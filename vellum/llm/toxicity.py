"""Toxicity by a classifier chain: categories are predicted in turn, and each later linear model also sees the earlier categories' probabilities, out of fold while it is trained.

Features are the presence of selected words (runs of letters, lower-cased) and a few measures of the whole
text. A category's words are those whose contexts differ most between its positive and negative texts, by a
z-score over distinct contexts (the word and the one before it), so that a word which near copies of one
text repeat counts once. The models are logistic regressions by Newton steps with a ridge.

Training rows are sampled by a hash of doc_id to ``TRAIN_DOCS`` at most of each category's labels in expectation;
the selected words (``WORDS`` per category) and the sample's features are what comes to the driver.

Defined results: a null text is empty; a category without both kinds of labels predicts 0 for every text;
rows of one doc_id in labels are each a training row; null labels are no labels, and a row without one category's
label still trains the others. Of equal texts, each category takes the label of the smallest doc_id that has one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, packed_row, row_schema, table, texts_of
from .letters import letter_words
from .vectext import chunks, lookup, mix

TRAIN_DOCS = 12_000
WORDS = 256
#: Least z-score of a selected word, and least number of distinct contexts that have it.
LEAST_Z, LEAST_CONTEXTS = 6.0, 8
FOLDS = 5
RIDGE = 0.3
THRESHOLD = 0.5
#: The chain of the labels table: a text of low quality, then a toxic one.
CHAIN = ("low_quality", "toxic")
MEASURES = 6


def features(texts: list[str], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive slices of texts: their measures, and (text, word) pairs of the selected words present."""
    for a, b, chunk in chunks(texts):
        codes, starts, ends, first = letter_words(chunk)
        hashes = chunk.hashes(starts, ends, codes)
        at, there = lookup(words, hashes)
        text = np.repeat(np.arange(b - a), np.diff(first))
        pairs = np.unique(text[there] * np.int64(max(len(words), 1)) + at[there])
        raw = chunk.codes
        length = np.diff(chunk.off) - 1
        sums = lambda mask: np.add.reduceat(mask.astype(np.int64), chunk.off[:-1])
        letters = np.bincount(text, ends - starts, b - a)
        upper, digits = sums((raw - np.uint32(65)) < 26), sums((raw - np.uint32(48)) < 10)
        plain = (raw == 32) | (raw == 10) | (raw == 44) | (raw == 46) | ((raw - np.uint32(48)) < 10) | (((raw | np.uint32(32)) - np.uint32(97)) < 26)
        marks = sums((raw < 128) & ~plain)
        n = np.maximum(length, 1)
        distinct = _distinct(text, hashes, b - a)
        per_text = np.maximum(np.diff(first), 1)
        yield np.stack((np.log1p(length), letters / n, upper / n, digits / n, marks / n, distinct / per_text), 1), pairs // max(len(words), 1), pairs % max(len(words), 1)


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(t[new], minlength=n)


class Linear:
    """A logistic regression over standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.mean[MEASURES:], self.scale[MEASURES:] = 0.0, 1.0  # presence and probabilities as they are
        z = np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1))), 1)
        w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], RIDGE)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)))


class Chain:
    def __init__(self, categories: list[str], words: np.ndarray, models: list[Linear | None]):
        self.categories, self.words, self.models = categories, words, models

    def probabilities(self, measures: np.ndarray, text: np.ndarray, word: np.ndarray) -> np.ndarray:
        """By text and category, each category after the ones before it."""
        present = np.zeros((len(measures), len(self.words)))
        present[text, word] = 1
        x = np.concatenate((measures, present), 1)
        out = np.zeros((len(measures), len(self.categories)))
        for k, m in enumerate(self.models):
            out[:, k] = m(np.concatenate((x, out[:, :k]), 1)) if m else 0.0
        return out


def _word_counts(categories: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array([batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(categories)], np.float64)
            for a, b, chunk in chunks(texts_of(batch)):
                codes, starts, ends, first = letter_words(chunk)
                hashes = chunk.hashes(starts, ends, codes)
                text = np.repeat(np.arange(b - a), np.diff(first))
                before = np.concatenate(([0], hashes[:-1])).astype(np.uint64)
                if len(before):
                    before[first[:-1][np.diff(first) > 0]] = 0
                context = mix(hashes + mix(before + np.uint64(1)))
                seen, at, back = np.unique(context, return_index=True, return_inverse=True)
                known = [np.bincount(back, ~np.isnan(labels[k, a:b][text]), len(seen)).astype(np.int64) for k in range(categories)]
                pos = [np.bincount(back, labels[k, a:b][text] == 1, len(seen)).astype(np.int64) for k in range(categories)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(seen.view(np.int64)), *map(pa.array, known), *map(pa.array, pos)], names=["word", "context", *(f"n{k}" for k in range(categories)), *(f"p{k}" for k in range(categories))])

    return f


def _featurise(words: np.ndarray):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, present = [], []
            for m, text, word in features(texts_of(batch), words):
                measures += m.tolist()
                cut = np.searchsorted(text, np.arange(len(m) + 1))
                present += [word[cut[i] : cut[i + 1]].tolist() for i in range(len(m))]
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(measures, pa.list_(pa.float64())), pa.array(present, pa.list_(pa.int64()))], names=[*(c for c in batch.schema.names if c != "text"), "measures", "present"])

    return f


def train(docs: DataFrame, labels: DataFrame, categories: list[str], train_docs: int = TRAIN_DOCS) -> Chain:
    """docs: doc_id, text; labels: doc_id and a 0/1 column for each category, in the chain's order."""
    ys = [f"y{k}" for k in range(len(categories))]
    slim = labels.select("doc_id", *(F.col(c).cast("double").alias(y) for c, y in zip(categories, ys, strict=True))).where("doc_id is not null").dropna("all", subset=ys)
    totals = slim.agg(*(F.count(y).alias(y) for y in ys)).first()
    if any(totals[y] > train_docs for y in ys):
        # a row is taken if the sample of any category that it has a label of takes it
        below = [F.when(F.col(y).isNotNull(), F.lit(min(1_000_000, int(1_000_000 * train_docs / max(totals[y], 1))))).otherwise(0) for y in ys]
        slim = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.greatest(*below, F.lit(0)))
    # the sample is bounded, so it is the side that is sent to all
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(slim), "doc_id")
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), *(F.min_by(y, F.when(F.col(y).isNotNull(), F.struct("doc_id", y))).alias(y) for y in ys))
    ns, ps = [f"n{k}" for k in range(len(ys))], [f"p{k}" for k in range(len(ys))]
    contexts = rows.select("text", *ys).mapInArrow(lean(_word_counts(len(ys))), "word long, context long, " + ", ".join(f"{c} long" for c in [*ns, *ps]))
    contexts = contexts.groupBy("word", "context").agg(*(F.sum(c).alias(c) for c in [*ns, *ps]))
    counted = contexts.groupBy("word").agg(*(F.sum((F.col(n) > 0).cast("long")).alias(n) for n in ns), *(F.sum((2 * F.col(p) > F.col(n)).cast("long")).alias(p) for n, p in zip(ns, ps, strict=True)))
    sums = rows.agg(*(F.count(y).alias(n) for n, y in zip(ns, ys, strict=True)), *(F.sum(y).alias(y) for y in ys)).first()
    selected: set[int] = set()
    for k, y in enumerate(ys):
        positive, all_ = float(sums[y] or 0), float(sums[f"n{k}"])
        if not 0 < positive < all_:
            continue
        rate = positive / all_
        z = (F.col(f"p{k}") - F.col(f"n{k}") * rate) / F.sqrt(F.col(f"n{k}") * rate * (1 - rate))
        best = counted.where(F.col(f"n{k}") >= LEAST_CONTEXTS).select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(WORDS)
        selected |= {r.word for r in best.collect()}
    words = np.sort(np.array(sorted(selected), np.int64).view(np.uint64))
    sample = rows.mapInArrow(lean(_featurise(words)), "doc_id long, " + ", ".join(f"{y} double" for y in ys) + ", measures array<double>, present array<long>").collect()
    models: list[Linear | None] = []
    if sample:
        sample.sort(key=lambda r: r.doc_id)
        x = np.zeros((len(sample), MEASURES + len(words)))
        for i, r in enumerate(sample):
            x[i, :MEASURES] = r.measures
            x[i, [MEASURES + w for w in r.present]] = 1
        fold = np.array([r.doc_id for r in sample]) % FOLDS
        for y in ys:
            target = np.array([r[y] for r in sample], np.float64)
            known = ~np.isnan(target)
            if not 0 < target[known].sum() < known.sum():
                models.append(None)
                x = np.concatenate((x, np.zeros((len(x), 1))), 1)
                continue
            models.append(Linear(x[known], target[known]))
            out = np.zeros(len(x))
            for k in range(FOLDS):
                own = fold == k
                rest = ~own & known
                out[own] = Linear(x[rest], target[rest])(x[own]) if 0 < target[rest].sum() < rest.sum() else target[rest].mean() if rest.any() else 0.0
            x = np.concatenate((x, out[:, None]), 1)
    else:
        models = [None] * len(ys)
    return Chain(list(categories), words, models)


def _predict(shared):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in batches:
            p = [chain.probabilities(*x) for x in features(texts_of(batch), chain.words)]
            all_ = np.concatenate(p) if p else np.zeros((0, len(chain.categories)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(all_[:, k]) for k in range(all_.shape[1]))], names=["row", *(f"p_{c}" for c in chain.categories)])

    return f


def score(docs: DataFrame, chain: Chain, keep: list[str] | None = None) -> DataFrame:
    """Each row as struct ``row`` (of the columns to keep, or all) with p_<category> for each category."""
    rows = docs.select(packed_row(keep or docs.columns).alias("row"), docs["text"].alias("text"))
    return rows.mapInArrow(lean(_predict(docs.sparkSession.sparkContext.broadcast(chain))), row_schema(rows.select("row"), ", ".join(f"`p_{c}` double" for c in chain.categories)))


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of a labels table (doc_id, quality, toxic)."""
    return train(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), list(CHAIN))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("row.doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
