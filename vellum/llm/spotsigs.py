"""Document fingerprints by spot signatures.

A signature is a common word (an anchor) and the next ``CHAIN`` content words after it; a text's fingerprint
is the set of its signatures, written as sorted 32-bit numbers in base 64. Likeness is the Jaccard
similarity of two fingerprints. A chain at the end of a text may be shorter. A content word that is in no
anchor's chain is an anchor itself, so every content word is in a signature and a text without common words
takes every word as an anchor. In a text of common words alone they are the content words too; a text without
words has its own hash as its one signature.

``matches`` finds all pairs of fingerprints at or above a threshold: sets are partitioned by length (a set of
n signatures meets only sets of threshold * n to n / threshold), the rarest signatures of each set are its
keys, and a pair that meets at a key is compared, longest list first, with a bound that stops early.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is alike to the empty
one (1) and to no other (0). The last document's next is the first; one document alone is its own next. Rows
without doc_id come first; rows of one doc_id are ordered by their text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table, written
from .ordered import bounds, in_order, parts_for
from .vectext import SEP, Chunk, hash_text, mix, runs, white

#: Common words of the corpus's languages (fixed values).
COMMON = {
    "en": "the a an and or of to in is are was were be been it its this that these those for on with as by at from not but have has had he she they we you i his her their our your will would can could there which who what when",
    "fr": "le la les un une des de du et ou est sont dans en pour par sur avec que qui ce cette ces il elle ils elles nous vous je au aux ne pas plus se sa son ses leur mais comme",
    "de": "der die das den dem des ein eine einer eines einem einen und oder ist sind war in im zu zum zur von vom mit für auf an am als auch nicht es er sie wir ihr ich bei nach aus wie dass sich",
    "es": "el la los las un una unos unas de del y o es son en por para con que se su sus lo al no más como pero este esta estos estas ha han fue era",
}
#: Content words of a chain.
CHAIN = 2
EDGE = 0x2E2F


def _common() -> np.ndarray:
    return np.unique(np.array([hash_text(w) for words in COMMON.values() for w in words.split()], np.uint64))


COMMON_HASHES = _common()


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's sorted, distinct 32-bit signatures."""
    chunk = Chunk([x.lower() for x in texts])
    codes = chunk.codes
    # words between white space, without the marks around them
    mark = (codes < 128) & ~(((codes - np.uint32(48)) < 10) | ((codes - np.uint32(97)) < 26)) | (codes == SEP) | white(codes)
    starts, ends = runs(~mark)
    words = chunk.hashes(starts, ends)
    first = chunk.per_text(starts)
    common = np.isin(words, COMMON_HASHES)
    out = []
    for i in range(len(texts)):
        w, c = words[first[i] : first[i + 1]], common[first[i] : first[i + 1]]
        if not len(w):
            out.append(np.array([hash_text(texts[i]) >> 32], np.uint32) if texts[i] else np.zeros(0, np.uint32))
            continue
        if c.any() and not c.all():
            anchors, content = w[c], w[~c]
            at = np.cumsum(~c)[c]  # content words before each anchor
            keep = at < len(content)
            anchors, at = anchors[keep], at[keep]
            chained = np.zeros(len(content) + CHAIN, bool)
            for k in range(CHAIN):
                chained[at + k] = True
            alone = np.flatnonzero(~chained[: len(content)])
            anchors, at = np.concatenate((anchors, content[alone])), np.concatenate((at, alone + 1))
        else:
            anchors, content, at = w, w, np.arange(1, len(w) + 1)
        content = np.concatenate((content, np.full(CHAIN, EDGE, np.uint64)))
        h = anchors
        for k in range(CHAIN):
            h = mix(h + np.uint64(k + 1)) ^ content[at + k]
        out.append(np.unique((mix(h) >> np.uint64(32)).astype(np.uint32)))
    return out


def fingerprint(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype(">u4").tobytes()).decode()


def signatures_of(text: str) -> np.ndarray:
    """A fingerprint's signatures."""
    return np.frombuffer(base64.b64decode(text), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a[0] > b[-1] or b[0] > a[-1]:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    both = int((long[at] == short).sum())
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Texts that are looked at together.
GROUP = 400


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, the next bucket's first row at its end."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]):
        texts = [r[2] for r in rows]
        own = signature_sets(texts)
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][3]]
        changed = [edited(texts[i], texts[j]) for i, j in pairs]
        new = signature_sets(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i, _ in pairs], pa.int64()),
                pa.array([len(texts[i]) for i, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                pa.array([fingerprint(own[i]) for i, _ in pairs], pa.string()),
                pa.array([fingerprint(x) for x in new], pa.string()),
                pa.array([likeness(own[i], x) for (i, _), x in zip(pairs, new, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[j]) for i, j in pairs], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "halo")), strict=True):
            if row[3] and held and held[-1][3] and held[-1][0] == row[0]:
                continue  # a second first row of the next bucket
            held.append(row)
            size += len(row[2])
            if len(held) > GROUP or size > 1_000_000:
                yield flush(held)
                held, size = held[-1:], len(held[-1][2])
    if len(held) > 1:
        yield flush(held)


def compared(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likenesses to it and to the next document."""
    spark = docs.sparkSession
    parts = parts_for(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    edges = bounds(slim, "doc_id", parts)
    bucket_of = F.lit(0)
    if len(edges):
        bucket_of = F.expr("aggregate(array({}), 0, (n, e) -> n + int(e <= doc_id))".format(",".join(f"{e}L" for e in edges.tolist()))) if len(edges) <= 64 else _bucket_udf(edges)(F.coalesce("doc_id", F.lit(-(1 << 63))))
    placed = slim.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket_of).cast("int"))
    # the first document of each bucket (one a partition) also ends the bucket before it
    firsts = sorted((r.bucket, r.first) for r in placed.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    also = spark.createDataFrame([(first, firsts[k - 1][0], 1 + (k == 0)) for k, (_, first) in enumerate(firsts)], "first long, to int, late int")
    halo = placed.withColumn("first", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(F.broadcast(also), "first").select("doc_id", "text", F.col("to").alias("bucket"), F.col("late").alias("halo"))
    rows = placed.withColumn("halo", F.lit(0)).unionByName(halo)
    return in_order(rows, "bucket", parts, "halo", "doc_id", "text").mapInArrow(lean(_compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _bucket_udf(edges: np.ndarray):
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right"))

    return place


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int64) for x in signature_sets(texts)], pa.list_(pa.int64()))], names=["doc_id", "sigs"])


def matches(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All pairs of distinct fingerprints at or above the threshold, and each document's class.

    Returns (links: a, b, similarity of class ids a < b; members: doc_id, class_id). Documents of equal
    fingerprints are one class, named by its smallest doc_id; the empty fingerprint links with nothing.
    """
    sets = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(_signatures), "doc_id long, sigs array<long>").withColumn("print", F.sha2(F.array_join("sigs", ",").cast("binary"), 256)), "signatures")
    classes = sets.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    classes = written(classes, "classes")
    members = sets.select("doc_id", "print").join(classes.select("print", "class_id"), "print").select("doc_id", "class_id")
    full = classes.where("n > 0")
    # rare signatures first: a linked pair shares one among the first n - ceil(threshold * n) + 1
    spread = full.select("class_id", "n", F.explode("sigs").alias("sig"))
    counts = spread.groupBy("sig").count()
    ranked = spread.join(counts, "sig").withColumn("k", F.row_number().over(Window.partitionBy("class_id").orderBy("count", "sig")))
    keys = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    # partitions by length: powers of 1 / threshold; a set also goes to the partition above its own
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / threshold)) + 1e-9).cast("int")
    here = keys.select("sig", "class_id", "n", "k", step.alias("part"))
    there = here.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = there.alias("a"), here.alias("b")
    near = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & ((F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.class_id") < F.col("b.class_id"))) & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
    # what can still be shared after the places of the first shared signature
    left = 1 + F.least(F.col("a.n") - F.col("a.k"), F.col("b.n") - F.col("b.k"))
    pairs = a.join(b, near).where(left * (1 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-6).select(F.col("a.class_id").alias("x"), F.col("b.class_id").alias("y")).distinct()
    sx, sy = full.select(F.col("class_id").alias("x"), F.col("sigs").alias("sx")), full.select(F.col("class_id").alias("y"), F.col("sigs").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    scored = pairs.join(sx, "x").join(sy, "y").withColumn("similarity", both / (F.size("sx") + F.size("sy") - both))
    links = scored.where(F.col("similarity") >= threshold - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return links, members


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
