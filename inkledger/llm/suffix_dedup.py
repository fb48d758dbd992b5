"""Suffix-array dedup: remove bytes covered by a long string that also starts earlier.

Method: a logarithmic index family. Segments arrive at a task in batches; each new batch gets a suffix array of
its windows, which is merge-scanned against the suffix array of every existing level for matches of at least the
window's length, symbol by symbol; then the batch merges with levels of its own size, geometrically, by placing one
sorted array into the other (``IndexFamily``). Of windows that are equal the earliest place stays in the index and
the others are marked, so no match is lost and each content is there once.

Defined cases: null or empty text: nothing removed, hash of nothing. Texts shorter than a window: kept whole. A very
long text is looked at in stretches of ``repeats.STRIDE`` windows. A null doc_id has no place in the order: such rows
are returned unchanged. Rows equal in doc_id and text are one document and get equal results. Empty table: empty
result. Columns beside doc_id and text are not read by ``dedup`` and pass through ``dedup_texts``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c
from inkledger.llm import repeats as r

WIDTH = 100
GRAM = 32
#: Symbols of a batch; a level holds that times a power of two.
BATCH = 1 << 19


def heads(symbols: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number: a view, so it takes no memory."""
    return np.ndarray((max(0, len(symbols) - 7),), ">u8", symbols, strides=(1,))


def steps_of(width: int) -> list[int]:
    """Places in a window whose heads cover it."""
    return [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]


PLACE = ("doc", "ver", "pos")


class Level:
    """Segments with the suffix array of their windows: ``start`` and places in the order of the windows' contents."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, start: np.ndarray, doc: np.ndarray, ver: np.ndarray, pos: np.ndarray):
        self.symbols, self.first, self.start, self.doc, self.ver, self.pos = symbols, first, start, doc, ver, pos

    def only(self, keep: np.ndarray) -> Level:
        return Level(self.symbols, *(getattr(self, k)[keep] for k in ("first", "start", *PLACE)))

    def search(self, other: Level, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(where each window of ``other`` belongs in this suffix array, whether an equal window is there)."""
        low, high = (np.searchsorted(self.first, other.first, side) for side in ("left", "right"))
        mine, theirs = heads(self.symbols), heads(other.symbols)
        for step in steps[1:]:
            at = np.flatnonzero(low < high)
            if not len(at):
                break
            key = theirs[other.start[at] + step].astype(np.uint64)
            a, b = low[at], high[at]
            low[at] = self._bisect(mine, step, a, b, key, False)
            high[at] = self._bisect(mine, step, a, b, key, True)
        return low, low < high

    def _bisect(self, mine: np.ndarray, step: int, low: np.ndarray, high: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.arange(len(low))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            value = mine[self.start[middle] + step].astype(np.uint64)
            right = value <= key[open_] if after else value < key[open_]
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low


class IndexFamily:
    """Suffix arrays whose sizes are a batch times powers of two."""

    def __init__(self, width: int):
        if width < 8:
            raise ValueError("windows are eight bytes or longer")
        self.steps = steps_of(width)
        self.levels: list[tuple[int, Level]] = []
        self.marked: list[tuple[np.ndarray, ...]] = []

    def mark(self, *place: np.ndarray) -> None:
        self.marked.append(place)

    def sorted(self, p: r.Pieces) -> Level:
        """The suffix array of a batch; of equal windows the earliest stays."""
        seg, offset = p.windows()
        start = p.starts[seg] + offset
        place = [p.cols["doc"][seg], p.cols["ver"][seg], p.cols["pos"][seg].astype(np.int64) + offset]
        order, common = r.sort_windows(heads(p.symbols), start, self.steps)
        group = np.cumsum(common < len(self.steps))
        tied = np.flatnonzero((common == len(self.steps)) | np.r_[common[1:] == len(self.steps), False])
        own = order[tied]
        order[tied] = own[np.lexsort((place[2][own], place[1][own], place[0][own], group[tied]))]
        lead = np.flatnonzero(common < len(self.steps))
        of = order[lead][group - 1]
        later = ~np.logical_and.reduce([x[order] == x[of] for x in place])  # the same place again is a repeated row
        self.mark(*(x[order[later]] for x in place))
        kept = order[lead]
        first = heads(p.symbols)[start[kept]].astype(np.uint64) if len(kept) else np.zeros(0, np.uint64)
        return Level(p.symbols, first, start[kept], *(x[kept] for x in place))

    def scan(self, level: Level, batch: Level) -> Level:
        """Match the batch against a level: the earlier place of each match stays in the level; returns the rest of the batch."""
        at, hit = level.search(batch, self.steps)
        there, here = at[hit], np.flatnonzero(hit)
        old, new = [getattr(level, k)[there] for k in PLACE], [getattr(batch, k)[here] for k in PLACE]
        same, less = np.ones(len(here), bool), np.zeros(len(here), bool)
        for x, y in zip(new, old):
            less |= same & (x < y)
            same &= x == y
        for k, x, y in zip(PLACE, new, old):
            getattr(level, k)[there] = np.where(less, x, y)
        self.mark(*(np.where(less, y, x)[~same] for x, y in zip(new, old)))
        return batch.only(~hit)

    def add(self, p: r.Pieces) -> None:
        batch = self.sorted(p)
        for _, level in self.levels:
            batch = self.scan(level, batch)
        size = 0
        while self.levels and self.levels[-1][0] <= size:
            old_size, old = self.levels.pop()
            batch, size = self.merge(old, batch), old_size + 1
        self.levels.append((size, batch))

    def merge(self, a: Level, b: Level) -> Level:
        at, _ = a.search(b, self.steps)
        moved = b.start + len(a.symbols)
        return Level(np.concatenate([a.symbols, b.symbols]), np.insert(a.first, at, b.first), np.insert(a.start, at, moved), *(np.insert(getattr(a, k), at, getattr(b, k)) for k in PLACE))

    def result(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([m[k] for m in self.marked]) if self.marked else np.zeros(0, np.int64) for k in range(3))


def _index(scheme: r.Scheme, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily(scheme.width)
        for p in r.pieces(batches, scheme, batch):
            family.add(p)
        yield from r.marks_of(*family.result())

    return run


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batch: int = BATCH) -> DataFrame:
    """(doc_id, ver, spans) of documents with bytes to remove; ``docs`` as of ``docs_with_version``."""
    scheme = r.Scheme("bytes", width, gram, False)
    return r.repeated_windows(docs.where("doc_id is not null"), scheme, _index(scheme, batch), "suffix-dedup")


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.large_binary())
            for text, spans in zip(texts, batch.column("spans")):
                text = text.as_py() or b""
                starts, ends = r.covered(spans, width)
                kept = text
                if len(starts):
                    edges = np.r_[0, np.c_[starts, ends].ravel(), len(text)].tolist()
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
            passed = [k for k in batch.schema.names if k not in ("text", "spans", "ver")]
            arrays = [batch.column(k) for k in passed] + [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*passed, *names])

    return run


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    base = c.docs_with_version(docs)
    spans = repeated_bytes(base, width, gram, batch)
    return base.join(spans.hint("shuffle_hash"), ["doc_id", "ver"], "left").mapInArrow(c.tidy(_cut(width, False)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batch: int = BATCH) -> DataFrame:
    """The rows of ``docs`` with removed bytes cut from ``text``; half-cut characters at the edges go too. Other columns pass."""
    base = c.docs_with_version(docs)
    spans = repeated_bytes(base, width, gram, batch)
    rest = [f for f in docs.columns if f not in ("doc_id", "text")]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.coalesce("text", F.lit(""))).alias("ver"), F.col("text").isNull().alias("was_null"), F.struct(*(F.col(f"`{k}`") for k in rest), F.lit(0).alias(c.free_name(docs, "pad_"))).alias("rest_"))
    joined = whole.join(spans.hint("shuffle_hash"), ["doc_id", "ver"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    cut = joined.mapInArrow(c.tidy(_cut(width, True)), f"doc_id {kinds['doc_id']}, was_null boolean, rest_ {kinds['rest_']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    text = F.when(~F.col("was_null"), F.col("kept")).alias("text")
    return cut.select(*(text if k == "text" else F.col("doc_id") if k == "doc_id" else F.col("rest_")[k].alias(k) for k in docs.columns))
