"""Exact repeated windows of a sequence corpus: the routing that suffix-array and suffix-tree dedup share.

A *window* is ``width`` consecutive symbols (bytes or words) of one document. In each window the ``gram``-symbol
stretch with the least hash is its *anchor*, so equal windows have equal anchors at equal offsets. Consecutive
windows with one anchor form a *segment*. Three exchanges find every window that occurs earlier:

1. ``route``: packed records (anchor hash, segment hash, place) are dealt out by anchor. Each task streams them and
   keeps one place for each distinct segment: a later occurrence of a whole segment repeats all of its windows.
   A hot passage so costs a task one entry, however often it occurs. Segments count as the same if their anchors'
   hashes and their own agree, 128 bits in all. Anchors with two or more *different* segments go on
   (``requests``); all others cannot hold equal windows and are done.
2. ``fetch``: the symbols of requested segments are cut from their documents and dealt out by anchor.
3. the operator's own index (a family of suffix arrays, or prefix-split suffix trees) decides each window.

``strict`` tells whether only a smaller doc_id counts as earlier (True) or any earlier start does (False).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c

RECORD = [("anchor", "<u8"), ("seg", "<u8"), ("doc", "<i8"), ("ver", "<u4"), ("pos", "<u4"), ("n", "<u2")]
SPAN = np.dtype([("pos", "<u4"), ("n", "<u2")])
REQUEST = np.dtype([("anchor", "<u8"), ("pos", "<u4"), ("n", "<u2")])
MARKS = "kind byte, doc_id long, ver long, payload binary"
PIECE = [("anchor", "<u8"), ("doc", "<i8"), ("ver", "<u4"), ("pos", "<u4"), ("n", "<u2")]
#: Positions share a 64-bit word with the hash that windows compare by.
PLACE_BITS = np.uint64(26)
#: Windows of a long text that are looked at together.
STRIDE = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Index tasks for each shuffle partition: an index needs many times its symbols in memory.
INDEX_SPLIT = 4


@dataclass(frozen=True)
class Scheme:
    """What a symbol is, how long a window and an anchor are, and what counts as earlier."""

    unit: str  # "bytes" or "words"
    width: int
    gram: int
    strict: bool

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit symbols and the offsets of the documents among them."""
        if self.unit == "bytes":
            return c.BYTE_VALUE[data], offsets
        starts, ends, owner = c.words_of(data, offsets)
        return c.word_hashes(data, starts, ends), np.searchsorted(owner, np.arange(len(offsets)))

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(symbols, offsets, first symbol's place): a long text comes in stretches that overlap by all but one symbol of a window."""
        if len(offsets) > 2 or len(data) <= STRIDE:
            yield *self.symbols(data, offsets), 0
            return
        symbols = data if self.unit == "bytes" else self.symbols(data, offsets)[0]
        for at in range(0, max(1, len(symbols) - self.width + 1), STRIDE):
            part = symbols[at : at + STRIDE + self.width - 1]
            yield c.BYTE_VALUE[part] if self.unit == "bytes" else part, np.array([0, len(part)]), at


def segments(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of windows, anchor hash) of every segment."""
    n, reach = len(symbols), width - gram + 1
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, np.zeros(0, np.uint64)
    grams = c.Rolling(symbols).grams(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> PLACE_BITS << PLACE_BITS) | place
    low[grams >> PLACE_BITS == NONE >> PLACE_BITS] -= np.uint64(1) << PLACE_BITS
    for end in offsets[1:-1]:  # stretches that cross two documents are no anchors
        low[max(0, end - gram + 1) : end] = NONE
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = n - width + 1
    if span < reach:
        low = np.minimum(low[:m], low[reach - span : reach - span + m])
    low = low[:m]
    valid = np.zeros(m, bool)
    lengths = np.diff(offsets)
    for start, length in zip(offsets[:-1][lengths >= width], lengths[lengths >= width]):
        valid[start : start + length - width + 1] = True
    anchor = low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    return first, np.flatnonzero(last) - first + 1, grams[anchor[first].astype(np.int64)]


def _route(scheme: Scheme, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = c.Packer(RECORD, buckets)
        for batch in batches:
            doc, ver = c.column(batch, "doc_id"), c.column(batch, "ver")
            for i, j, data, offsets in c.text_chunks(batch):
                for symbols, cuts, base in scheme.stretches(data, offsets):
                    first, count, anchor = segments(symbols, cuts, scheme.width, scheme.gram)
                    if not len(first):
                        continue
                    whole = c.Rolling(symbols, 1).stretch(first, first + count - 1 + scheme.width)
                    row = np.searchsorted(cuts, first, "right") - 1
                    yield from out.add(anchor, anchor, whole, doc[i:j][row], ver[i:j][row], first - cuts[row] + base, count)
        yield from out.flush()

    return run


def _by_document(kind: int, doc: np.ndarray, ver: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a document with its records packed."""
    if not len(doc):
        return
    order = np.lexsort((ver, doc))
    doc, ver, records = doc[order], ver[order], records[order]
    at = c.run_starts(doc, ver)
    offsets = (np.r_[at, len(doc)] * records.dtype.itemsize).astype(np.int64)
    blobs = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())]).cast(pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int8()), pa.array(doc[at], pa.int64()), pa.array(ver[at].astype(np.int64)), blobs], names=["kind", "doc_id", "ver", "payload"])


def _fields(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def grown(batches: Iterator[pa.RecordBatch], fields, fold: Callable, least: int = 500_000) -> Iterator:
    """Fold records into what is held whenever as many have come as are held, so that each is sorted again a logarithmic number of times.

    ``fold(held and new records)`` returns (what stays held, a result); yields the results and at the end what is held.
    """
    held: dict[str, np.ndarray] | None = None
    waiting: list[dict[str, np.ndarray]] = []
    count = 0
    for piece in c.unpacked(batches, fields, least):
        waiting.append(piece)
        count += len(piece[fields[0][0]])
        if count >= max(least, 0 if held is None else len(held[fields[0][0]])):
            held, result = fold({k: np.concatenate([*([] if held is None else [held[k]]), *(w[k] for w in waiting)]) for k, _ in fields})
            waiting, count = [], 0
            yield result, None
    if waiting:
        held, result = fold({k: np.concatenate([*([] if held is None else [held[k]]), *(w[k] for w in waiting)]) for k, _ in fields})
        yield result, None
    if held is not None:
        yield None, held


def _first_places(strict: bool) -> Callable:
    def fold(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        order = np.lexsort((x["pos"], x["ver"], x["doc"], x["seg"], x["anchor"]))
        x = {k: v[order] for k, v in x.items()}
        once = c.run_starts(*(x[k] for k in ("anchor", "seg", "doc", "ver", "pos")))  # repeated rows
        x = {k: v[once] for k, v in x.items()}
        at = c.run_starts(x["anchor"], x["seg"])
        if strict:
            keep = x["doc"] == np.repeat(x["doc"][at], np.diff(np.r_[at, len(x["doc"])]))
        else:
            keep = np.zeros(len(x["doc"]), bool)
            keep[at] = True
        return {k: v[keep] for k, v in x.items()}, {k: v[~keep] for k, v in x.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for gone, held in grown(batches, RECORD, fold):
            if gone is not None:
                yield from _by_document(0, gone["doc"], gone["ver"], _fields(SPAN, pos=gone["pos"], n=gone["n"]))
        if held is None:
            return
        groups = c.run_starts(held["anchor"])
        size = np.diff(np.r_[groups, len(held["anchor"])])
        differ = np.zeros(len(held["seg"]), np.int64)
        differ[1:] = (held["seg"][1:] != held["seg"][:-1]) & (held["anchor"][1:] == held["anchor"][:-1])
        several = np.repeat(np.add.reduceat(differ, groups) > 0, size) if len(groups) else np.zeros(0, bool)
        x = {k: v[several] for k, v in held.items()}
        yield from _by_document(1, x["doc"], x["ver"], _fields(REQUEST, anchor=x["anchor"], pos=x["pos"], n=x["n"]))

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _fetch(scheme: Scheme, buckets: int) -> Callable:
    raw = scheme.unit == "bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ver, asked = c.column(batch, "doc_id"), c.column(batch, "ver"), batch.column("asked")
            for i, j, data, offsets in c.text_chunks(batch):
                symbols, cuts = (data, offsets) if raw else scheme.symbols(data, offsets)
                rows, parts = [], []
                for r in range(i, j):
                    got = np.frombuffer(b"".join(x.as_py() for x in asked[r]), REQUEST)
                    parts.append(got)
                    rows.append(np.full(len(got), r - i))
                x, row = np.concatenate(parts), np.concatenate(rows)
                bucket = c.mix(x["anchor"]) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                x, row, bucket = x[order], row[order], bucket[order].astype(np.int32)
                start, length = cuts[row] + x["pos"], x["n"].astype(np.int64) + scheme.width - 1
                cols = dict(anchor=x["anchor"], doc=doc[i:j][row], ver=ver[i:j][row], pos=x["pos"], n=x["n"])
                at = np.r_[c.run_starts(bucket), len(bucket)]
                blobs = [np.int64(b - a).tobytes() + b"".join(cols[k][a:b].astype(kind).tobytes() for k, kind in PIECE) + symbols[ragged(start[a:b], length[a:b])].tobytes() for a, b in zip(at, at[1:])]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

    return run


@dataclass
class Pieces:
    """Fetched segments: their places, and their symbols one after another."""

    cols: dict[str, np.ndarray]
    symbols: np.ndarray
    width: int

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(segment, offset within it) of every window."""
        n = self.cols["n"].astype(np.int64)
        return np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)

    @property
    def starts(self) -> np.ndarray:
        length = self.cols["n"].astype(np.int64) + self.width - 1
        return np.cumsum(length) - length


def pieces(batches: Iterator[pa.RecordBatch], scheme: Scheme, limit: int) -> Iterator[Pieces]:
    """A task's segments in batches of about ``limit`` symbols."""
    kind = np.uint8 if scheme.unit == "bytes" else np.uint64
    cols: list[dict] = []
    symbols: list[np.ndarray] = []
    held = 0
    fixed = sum(np.dtype(k).itemsize for _, k in PIECE)

    def joined() -> Pieces:
        return Pieces({k: np.concatenate([x[k] for x in cols]) for k, _ in PIECE}, np.concatenate(symbols), scheme.width)

    for batch in batches:
        for blob in batch.column("payload"):
            blob = blob.as_py()
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            cols.append(c.unpack(PIECE, blob[8 : 8 + n * fixed]))
            symbols.append(np.frombuffer(blob, kind, offset=8 + n * fixed))
            held += len(symbols[-1])
            if held >= limit:
                yield joined()
                cols, symbols, held = [], [], 0
    if cols:
        yield joined()


def marks_of(doc: np.ndarray, ver: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Mark single windows as repeated; neighbours join to spans."""
    order = np.lexsort((pos, ver, doc))
    doc, ver, pos = doc[order], ver[order], pos[order].astype(np.int64)
    if not len(doc):
        return
    run = np.r_[True, (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1]) | (pos[1:] != pos[:-1] + 1)]
    at = np.flatnonzero(run)
    count = np.diff(np.r_[at, len(doc)])
    while (count > 60_000).any():  # spans hold 16-bit counts
        big = count > 60_000
        at, count = np.r_[at, at[big] + 60_000], np.r_[np.where(big, 60_000, count), count[big] - 60_000]
    yield from _by_document(0, doc[at], ver[at], _fields(SPAN, pos=pos[at], n=count))


def sort_windows(keys: np.ndarray, starts: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows by their keys at ``start + step`` for each step in turn, step at which each differs from the one before).

    Windows equal at all steps have ``len(steps)`` there; the first window has 0. Only ties are sorted on.
    """
    n = len(starts)
    key = keys[starts + steps[0]].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    common = np.full(n, len(steps), np.int64)
    common[:1] = 0
    common[1:][key[1:] != key[:-1]] = 0
    for k, step in enumerate(steps[1:], 1):
        same = common == len(steps)
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        group = np.cumsum(~same[tied])
        key = keys[starts[order[tied]] + step].astype(np.uint64)
        again = np.lexsort((key, group))
        order[tied], key = order[tied][again], key[again]
        differs = np.r_[False, (key[1:] != key[:-1]) & (group[1:] == group[:-1])]
        common[tied[differs]] = k
    return order, common


def repeated_windows(docs: DataFrame, scheme: Scheme, index: Callable, name: str) -> DataFrame:
    """One row a document (doc_id, ver, spans array<binary>) with the spans of windows that occur earlier.

    ``docs`` has doc_id, ver and text, without null ids. ``index`` is a ``mapInArrow`` function from packed pieces to ``MARKS``.
    """
    buckets = c.partitions(docs.sparkSession)
    routed = c.exchange(docs.mapInArrow(c.tidy(_route(scheme, buckets)), c.PACKED), buckets)
    first = c.write_table(routed.mapInArrow(c.tidy(_first_places(scheme.strict)), MARKS), f"{name}-first")
    asked = first.where("kind = 1").groupBy("doc_id", "ver").agg(F.collect_list("payload").alias("asked"))
    groups = buckets * INDEX_SPLIT
    cut = docs.join(asked.hint("shuffle_hash"), ["doc_id", "ver"]).mapInArrow(c.tidy(_fetch(scheme, groups)), c.PACKED)
    decided = c.write_table(c.exchange(cut, groups).mapInArrow(c.tidy(index), MARKS), f"{name}-decided")
    spans = first.where("kind = 0").unionByName(decided)
    return spans.groupBy("doc_id", "ver").agg(F.collect_list("payload").alias("spans"))


def covered(spans: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of symbols that a document's repeated windows cover."""
    got = spans.as_py()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.frombuffer(b"".join(got), SPAN)
    pos = x["pos"].astype(np.int64)
    return c.merged(pos, pos + x["n"] - 1 + width)
