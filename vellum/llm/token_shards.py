"""Token ids of a corpus in ascending document order, one wavelet matrix file per shard.

Texts are encoded where they are read; only packed ids move, to buckets of consecutive doc_ids. Each bucket's
task writes files of at most ``SHARD_TOKENS`` tokens (or one longer document) to the shared folder, each
under a temporary name first, so a lost or repeated task leaves the same whole files. The manifest (a row a
file) holds each file's first token's place in the corpus.

Defined results: null and empty texts have the end id alone; rows without doc_id come first (as the smallest
id); rows of one doc_id stand in the order of their ids; texts outside the plain range of code points, or with
a special token's string, are encoded whole by the library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, lean, put_file, shared_folder, stage_cache, table, texts_of, written
from .ordered import bounds, in_order, parts_for
from .pretokens import Memo, Splitter, tokenizer
from .vectext import SEP, chunks, ragged
from .wavelet import WaveletMatrix, encode

END_ID = 1
SHARD_TOKENS = 4_000_000
NULL_ID = -(1 << 63)


class Encoder:
    """Ids of texts as a lower-casing, white-space-dropping tokenizer file gives them."""

    def __init__(self, name: str):
        self.library = tokenizer(name)
        self.split, self.memo = Splitter(self.library, gaps=False), Memo(self.library)
        self.wide = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.lower = np.arange(SEP + 1, dtype=np.uint32)
        for c in range(0x250):
            if c != 0x130:
                self.lower[c] = ord(chr(c).lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        odd = {i for i, x in enumerate(texts) if "<|" in x}
        for a, b, chunk in chunks(texts):
            strange = np.flatnonzero(((chunk.codes >= 0x250) & (chunk.codes != SEP)) | (chunk.codes == 0x130))
            odd.update((a + np.searchsorted(chunk.off, strange, "right") - 1).tolist())
            codes = chunk.codes.copy()
            codes[strange] = 32
            codes = self.lower[codes]
            starts, ends = self.split.spans(codes)
            rows = self.memo.rows(chunk, codes, starts, ends) if len(starts) else np.zeros(0, np.int64)
            lengths = self.memo.lengths[rows]
            ids = self.memo.pool[ragged(self.memo.first[rows], lengths)] if len(rows) else np.zeros(0, np.uint32)
            first = np.concatenate(([0], np.cumsum(lengths)))[chunk.per_text(starts)]
            out.extend(np.append(ids[first[i] : first[i + 1]], END_ID) for i in range(b - a))
        for i in odd:
            out[i] = np.append(np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32), END_ID)
        return out


_encoders: dict[str, Encoder] = stage_cache()


def _encode(name: str, edges: np.ndarray):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoders.get(name) or _encoders.setdefault(name, Encoder(name))
        for batch in batches:
            keys = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            ids = e.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, keys, "right"), pa.int32()), pa.array(keys), pa.array([x.astype(e.wide).tobytes() for x in ids], pa.binary())], names=["bucket", "doc_id", "ids"])

    return f


def _write(folder: str, wide: type, shard_tokens: int):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, shard, size, docs, parts = -1, 0, 0, [], []

        def flush():
            name = f"shard-{bucket:06d}-{shard:06d}.wvm"
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            put_file(folder, name, encode(np.concatenate(parts), np.array(docs, np.int64), offsets))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [name], "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})

        for batch in batches:
            for b, doc, raw in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, wide)
                if parts and (b != bucket or size + len(ids) > shard_tokens):
                    yield flush()
                    shard, size, docs, parts = shard + 1 if b == bucket else 0, 0, [], []
                bucket = b
                docs.append(doc)
                parts.append(ids)
                size += len(ids)
        if parts:
            yield flush()

    return f


MANIFEST = "bucket int, shard int, file string, docs long, tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str = "word_bpe_49k.json", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files and returns their manifest: bucket, shard, file, docs, tokens, start."""
    parts = parts_for(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    edges = bounds(slim, "doc_id", parts)
    wide = np.uint16 if tokenizer(tokenizer_file).get_vocab_size() <= 1 << 16 else np.uint32
    coded = slim.mapInArrow(lean(_encode(tokenizer_file, edges)), "bucket int, doc_id long, ids binary")
    manifest = written(in_order(coded, "bucket", parts, "doc_id", "ids").mapInArrow(lean(_write(folder, wide, shard_tokens)), MANIFEST), "manifest")
    # a sum for each bucket (as many as partitions) goes to the driver; files are numbered within buckets
    sums = sorted((r.bucket, r.n) for r in manifest.groupBy("bucket").agg(F.sum("tokens").alias("n")).collect())
    before, offsets = 0, []
    for b, n in sums:
        offsets.append((b, before))
        before += n
    base = docs.sparkSession.createDataFrame(offsets, "bucket int, base long")
    inner = Window.partitionBy("bucket").orderBy("shard")
    return manifest.join(F.broadcast(base), "bucket").select(*manifest.columns, (F.col("base") + F.sum("tokens").over(inner) - F.col("tokens")).alias("start"))


def _read(folder: str):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as x:
                    w = WaveletMatrix(x.read())
                ids, offsets = w.all().astype("<u4"), w.offsets
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, mask=w.doc_ids == NULL_ID), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return f


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    parts = max(parts_for(manifest), 1)
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(lean(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-shards")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder), folder)
