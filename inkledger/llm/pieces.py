"""SentencePiece encoding and decoding by batched numpy Viterbi.

The piece table comes from a model file; no piece holds a space mark behind another character, nor a line feed, so
texts fall into words that are segmented alone. Distinct words of equal length advance together: rolling substring hashes probe
the sorted piece keys, and vectorised maxima over the possible last pieces store backpointers. A character that no
piece covers is spelled in bytes.

Scores: a unigram model's own log probabilities. For a merge-ranked vocabulary the rank gives Zipf's estimate
``-log(rank + 2.7) - log(H)``, H the sum that makes the shares add up to one. Ties go to the longer last piece.

Defined cases: null or empty text: no ids, decoded to the empty text. A space mark in a text decodes to a space.
Repeated rows are coded each. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c

MARK = "▁"
WORDS_KEPT = 250_000
GROUP = 1 << 15
BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        pieces = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(n) if not kinds[i] and not model.is_byte(i)]
        own = [s for _, _, s in pieces if s > -1e8]
        if min(own) < -1000:  # merge ranks
            share = np.log(np.sum(1 / (np.arange(n) + 2.7)))
            pieces = [(i, p, -float(np.log(max(0.0, -s if s > -1e8 else n) + 2.7) + share)) for i, p, s in pieces]
        self.longest = max(len(p) for _, p, _ in pieces)
        keys = np.concatenate([self._keys([p for _, p, _ in pieces if len(p) == k]) for k in range(1, self.longest + 1)])
        flat = [x for k in range(1, self.longest + 1) for x in pieces if len(x[1]) == k]
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.ids = np.array([x[0] for x in flat], np.int32)[order]
        self.scores = np.array([x[2] for x in flat])[order]
        self.unknown = float(self.scores.min()) - 10
        self.text = [b""] * n
        for i, p, _ in pieces:
            self.text[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.text[i] = bytes([b])
        self.words: dict[str, bytes] = {}
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k]
        return out

    def _keys(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        sums = self._sums(self._codes(words))
        return c.mix(sums[:, -1] ^ np.uint64(sums.shape[1] - 1) << np.uint64(56))

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian i32) of words of one length."""
        n, length = len(words), len(words[0])
        codes = self._codes(words)
        sums = self._sums(codes)
        power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, BASE)])
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        for end in range(1, length + 1):
            starts = range(max(0, end - self.longest), end)
            score, which = np.empty((len(starts), n)), np.empty((len(starts), n), np.int32)
            for k, start in enumerate(starts):
                key = c.mix((sums[:, end] - sums[:, start] * power[end - start]) ^ np.uint64(end - start) << np.uint64(56))
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                which[k] = np.where(hit, self.ids[at], -1)
                score[k] = best[:, start] + np.where(hit, self.scores[at], self.unknown if start == end - 1 else -np.inf)
            top = score.argmax(axis=0)  # the first of equals is the longest piece
            rows = np.arange(n)
            best[:, end], piece[:, end], back[:, end] = score[top, rows], which[top, rows], top + starts[0]
        out = np.full((n, length), -2, np.int32)
        end = np.full(n, length)
        for step in range(length - 1, -1, -1):
            live = np.flatnonzero(end > 0)
            if not len(live):
                break
            out[live, step] = piece[live, end[live]]
            end[live] = back[live, end[live]]
        coded = []
        used = out != -2
        odd = (out == -1).any(axis=1)
        for k in range(n):
            ids = out[k][used[k]]
            coded.append(self._spelled(words[k], ids) if odd[k] else ids.tobytes())
        return coded

    def _spelled(self, word: str, ids: np.ndarray) -> bytes:
        out, at = [], 0
        for i in ids.tolist():
            if i == -1:
                out += [self.byte_id[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.text[i].decode())
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        by_length: dict[int, list[str]] = {}
        for w in sorted(set().union(*cut) - self.words.keys()):
            by_length.setdefault(len(w), []).append(w)
        for length, words in by_length.items():
            step = max(1, GROUP * 8 // length)
            for at in range(0, len(words), step):
                part = words[at : at + step]
                self.words.update(zip(part, self.viterbi(part)))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = coder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 1000):
                ids = model.encode(texts[at : at + 1000])
                n = np.array([len(x) // 4 for x in ids])
                flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                back = [hashlib.sha256(model.decode(np.frombuffer(x, np.int32).tolist()).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + len(ids)], pa.array(n, pa.int64()), flat, pa.array(back, pa.string())], names=["doc_id", "n_ids", "ids", "decoded_sha256"])
        model.words = {}  # a worker serves later tasks, of other operators too

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 (of the text that the ids decode to) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(c.tidy(_encode(path)), "doc_id long, n_ids long, ids array<int>, decoded_sha256 string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = coder(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row with doc_id and ids."""
    return coded.select("doc_id", "ids").mapInArrow(c.tidy(_decode(path)), "doc_id long, text string")
