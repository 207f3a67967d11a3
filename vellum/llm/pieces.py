"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At every position the automaton's output links give all pieces that end there, longest first; each relaxes
the best score of its end. A character that is no piece itself can be spelled by its byte pieces at a cost
below every piece. Of equal scores the longest last piece stays. No piece of the model goes over the start
of a word (a run of U+2581 after something else), so the best path of a text is the best paths of its words
in a row, and each distinct word of a worker's blocks is solved once.

The scores are the model's. For a model trained by merging (its scores are merge ranks) the best path
under these scores is this operator's own segmentation and differs from the merge order's; decoding gives
the text back in either case.

Defined results: null and empty texts have no ids; a literal U+2581 is spelled by bytes, so that decoding is
exact for every text; repeated rows are each encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, packed_row, row_schema, stage_cache, table, texts_of
from .vectext import SEP, Chunk, chunks, lookup, ragged

#: Stands for a space in pieces.
GAP = "▁"
#: Stands for a literal U+2581 while a text is split; a noncharacter, in no piece.
LITERAL = "﷐"
#: A character spelled by bytes costs this more than the worst piece.
PENALTY = 10.0
#: Distinct words that a worker remembers before it starts anew.
MEMO = 400_000


class Model:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.piece: list[bytes] = [b""] * n
        self.automaton, self.single = ahocorasick.Automaton(), set()
        # pieces of white space alone are marked with -1e9; they count as the worst of the others
        worst = min(sp.get_score(i) for i in range(n) if sp.get_score(i) > -1e8)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.piece[i] = bytes([int(p[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[i] = p.replace(GAP, " ").encode()
                self.automaton.add_word(p, (len(p), max(sp.get_score(i), worst), i))
                if len(p) == 1:
                    self.single.add(p)
        self.automaton.make_automaton()
        self.fallback = worst - PENALTY
        self.sizes = np.fromiter(map(len, self.piece), np.int64, n)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.piece), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes.values())] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.uint32)

    def viterbi(self, word: str) -> tuple[float, list[int]]:
        """The best score of a word, and its ids."""
        n = len(word)
        best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        plain = self.single.issuperset(word)
        done = 0  # ends up to here are settled
        for end, match in self.automaton.iter(word):
            if not plain and end > done:
                self._fall_back(word, best, back, done, end)
                done = end
            score = best[end + 1 - match[0]] + match[1]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, match
        if not plain:
            self._fall_back(word, best, back, done, n)
        ids: list[int] = []
        at = n
        while at:
            match = back[at]
            if match is None:
                c = GAP if word[at - 1] == LITERAL else word[at - 1]
                ids.extend(self.bytes[b] for b in reversed(c.encode()))
                at -= 1
            else:
                ids.append(match[2])
                at -= match[0]
        ids.reverse()
        return best[n], ids

    def _fall_back(self, word: str, best: list, back: list, start: int, end: int) -> None:
        """Relaxes the ends after start, up to end, by spelling a character that is no piece."""
        for at in range(start, end):
            if word[at] not in self.single and best[at] + self.fallback > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.fallback, None

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For consecutive slices of texts: all ids in a row, where each text's begin, each text's score."""
        for _, _, chunk in chunks([f" {x}" if x else "" for x in texts]):
            codes = np.where(chunk.codes == ord(GAP), np.uint32(ord(LITERAL)), chunk.codes)
            codes[codes == 32] = ord(GAP)
            gap, end = codes == ord(GAP), codes == SEP
            cut = end.copy()
            cut[0] = True
            cut[1:] |= (gap[1:] & ~gap[:-1]) | end[:-1]
            edges = np.flatnonzero(np.concatenate((cut, [True])))
            starts, ends = edges[:-1], edges[1:]
            keep = ~end[starts]
            starts, ends = starts[keep], ends[keep]
            rows = self._rows(chunk, codes, starts, ends)
            lengths = self.lengths[rows]
            first = chunk.per_text(starts)
            yield self.ids[ragged(self.first[rows], lengths)], np.concatenate(([0], np.cumsum(lengths)))[first], np.diff(np.concatenate(([0.0], np.cumsum(self.scores[rows])))[first])

    def _rows(self, chunk: Chunk, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = chunk.hashes(starts, ends, codes)
        _, there = lookup(self.keys, hashes)
        if len(self.keys) > MEMO and not there.all():
            self.clear()
            there[:] = False
        fresh, where = np.unique(hashes[~there], return_index=True)
        where = np.flatnonzero(~there)[where]
        found = [self.viterbi(codes[a:b].tobytes().decode("utf-32-le")) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        lengths = np.fromiter((len(x) for _, x in found), np.int64, len(found))
        keys = np.concatenate((self.keys, fresh))
        order = np.argsort(keys, kind="stable")
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(lengths) - lengths))[order]
        self.lengths = np.concatenate((self.lengths, lengths))[order]
        self.scores = np.concatenate((self.scores, np.fromiter((s for s, _ in found), float, len(found))))[order]
        self.ids = np.concatenate((self.ids, np.fromiter((i for _, x in found for i in x), np.uint32, int(lengths.sum()))))
        self.keys = keys[order]
        return np.searchsorted(self.keys, hashes)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.pool[ragged(self.offsets[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of one text."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")[1:]


_models: dict[str, Model] = stage_cache()


def model(name: str) -> Model:
    return _models.get(name) or _models.setdefault(name, Model(public_tokenizers.path(name)))


def _encode(name: str, with_ids: bool):
    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for batch in batches:
            texts, rows = texts_of(batch), []
            at = 0
            for ids, first, scores in m.encode(texts):
                for i in range(len(first) - 1):
                    own = ids[first[i] : first[i + 1]]
                    text = texts[at + i]
                    rows.append((len(own), int(m.is_byte[own].sum()), float(scores[i]), zlib.crc32(own.astype("<u4").tobytes()), m.decode_bytes(own)[1:] == text.encode(), own if with_ids else None))
                at += len(first) - 1
            columns = [batch.column("row"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())))]
            names = ["row", "n_tokens", "n_byte_tokens", "score", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return f


def encode(docs: DataFrame, keep: list[str], text: str = "text", model_file: str = "piece_bpe_32k.model", with_ids: bool = True) -> DataFrame:
    """The kept columns of each row; n_tokens, n_byte_tokens, score, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text) and, if wanted, ids."""
    rows = docs.select(packed_row(keep).alias("row"), F.col(text).alias("text"))
    schema = row_schema(rows.select("row"), "n_tokens long, n_byte_tokens long, score double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)
    out = rows.mapInArrow(lean(_encode(model_file, with_ids)), schema)
    return out.select("row.*", *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)
