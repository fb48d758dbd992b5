"""Language-model scores by online logistic context mixing, beside an add-one word model over the same tokens.

What is scored is a text's token sequence: A-Z lower-cased, words joined by one space, then an end byte, so both models speak
of the same event. A byte is a path of binary decisions in a Huffman tree that the byte before it picks. Five predictors,
pairs of bit counts under (hashed) contexts of 1 to 5 bytes, give their log odds for every decision; a gate, chosen by how
often the orders 3 to 5 have seen their contexts, picks the weight vector that combines them. Weights are learned online:
training decisions pass in batches, each predicted before it is learned from and with its own occurrence taken out of all
counts. An adaptive map by last byte and mixed odds, counted in the same way, refines the result. A decision's two
probabilities sum to one, so a text's score is the log10 probability of its bytes.

A byte's probability depends on six bytes alone, and distinct strings of six bytes are few (3 % of 16 MB), so the model is
gathered from all training documents and applied to all documents by exchanging those:

1. chunks (``CHUNK_BYTES`` of a partition) list their distinct strings with training counts, and their distinct words;
2. buckets by string sum the counts, and hand each string once to the bucket of its last three context bytes, where all
   counts of its orders 3 to 5 meet; orders 1 and 2 (at most 2^22 + 2^16 sums, hashed) go to every task;
3. a bucket's mixer learns and gives every string its log2 probability;
4. buckets by string hand these back to the chunks that listed it, at most once a chunk each;
5. a chunk adds them up along its texts, which wait in the shared folder as one compressed row a chunk.

Counts of words go the same way as strings, exactly, by Spark's own grouping and join.

Defined cases: null text: empty, a lone end token. Very long texts are scored whole (a longer text than a chunk is one of its
own). A null doc_id is not held out. Rows of one id are scored each for itself. Without training documents N, V and all
counts are 0, every base score is 0, and the score is that of untaught predictors. Empty table: no rows. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

CHUNK_BYTES, BLOCK_BYTES = 16 << 20, 2 << 20
HELD_OUT = (7, 2)
END = 0xFF
PAD = bytes([END]) * 5
#: Strings that a bucket of step 2 and a mixer of step 3 get on average.
BUCKET_ROWS, MIXER_ROWS = 1 << 20, 1 << 18
#: log2 of the hashed contexts of order 2.
SLOT_BITS = 14
#: Added to bit counts, learning rate, decisions a batch, passes, decisions of all passes (all training decisions pass once at least), cells of the adaptive map, its inertia.
PRIOR, RATE, BATCH, PASSES, TEACH, CELLS, INERTIA = 0.15, 0.03, 4096, 12, 1 << 20, 33, 20
FLOOR = 1e-5
ORDERS, GATES = 5, 60


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


# ---- texts ---------------------------------------------------------------------------------------------------------


def _stream(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes, each after ``PAD`` and before its end byte; start and end of what is scored of each, from place 5 on."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes + len(PAD) - 1) - (len(PAD) - 1)
    return PAD + PAD.join(texts) + PAD + bytes(8), ends - sizes, ends


def _grams(data: bytes, n: int) -> np.ndarray:
    """The n bytes up to each place from 5 on, the last one highest."""
    window = np.ndarray((max(0, len(data) - 8 - 5),), "<u8", data, 6 - n, (1,))
    return (window & np.uint64((1 << 8 * n) - 1)).astype(np.int64)


def _inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places are in one of the stretches."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_BYTES``; a longer text is a block of its own."""
    upto = np.cumsum([len(t) + 6 for t in texts])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield at, end
        at = end


def _strings(texts: list[bytes], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 6-byte strings at scored places, ascending, and how often the training documents have them."""
    keys, counts = [], []
    for at, end in _blocks(texts):
        data, starts, ends = _stream(texts[at:end])
        grams = _grams(data, 6)
        scored = _inside(len(grams), starts, ends)
        codes, unique = pd.factorize(grams)
        taught = ~held[at:end]
        n = np.bincount(codes[_inside(len(grams), starts[taught], ends[taught])], minlength=len(unique))
        there = np.bincount(codes[scored], minlength=len(unique)) > 0
        keys.append(unique[there])
        counts.append(n[there])
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = c.run_starts(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed; ascending ones should come as differences."""
    return len(columns[0]).to_bytes(8, "little") + pa.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns), "zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, out, at = int.from_bytes(blob[:8], "little"), [], 0
    width = sum(np.dtype(k).itemsize for k in kinds)
    raw = np.frombuffer(pa.decompress(blob[8:], n * width, "zstd"), np.uint8)
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (c.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket and key, where each bucket begins, its number) of ascending keys."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    first = c.run_starts(bucket[order])
    return order, np.r_[first, len(keys)], bucket[order][first]


# ---- step 1 ----------------------------------------------------------------------------------------------------------

_TEXTS, _ASKS, _WORDS, _ODDS = 0, 1, 2, 3
_ROW = "kind int, chunk long, bucket int, payload binary, word binary, place int, n long"
_FIELDS = [("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("word", pa.binary()), ("place", pa.int32()), ("n", pa.int64())]


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])


def _chunk_rows(chunk: int, ids: list, held: list[bool], texts: list[bytes], counts: dict[bytes, int], buckets: int) -> Iterator[pa.RecordBatch]:
    sink = pa.BufferOutputStream()
    table = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "held_out": held, "text": pa.array(texts, pa.large_binary())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    yield _rows(1, kind=[_TEXTS], chunk=[chunk], payload=[sink.getvalue().to_pybytes()], n=[held.count(False)])
    keys, n = _strings(texts, np.array(held, bool))
    order, bounds, own = _parts(keys, buckets)
    keys, n = keys[order], n[order].astype(np.uint32)
    blobs = [_packed(np.diff(keys[i:j], prepend=0), n[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    yield _rows(len(own), kind=[_ASKS] * len(own), chunk=[chunk] * len(own), bucket=own.astype(np.int32), payload=blobs, n=np.diff(bounds))
    words = list(counts)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield _rows(len(part), kind=[_WORDS] * len(part), chunk=[chunk] * len(part), word=part, place=np.arange(at, at + len(part), dtype=np.int32), n=[counts[w] for w in part])


def _read(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, held, texts, counts, size = TaskContext.get().partitionId() << 32, [], [], [], {}, 0
        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.large_binary())):
                words, one = (t.as_py() or b"").lower().split(), 0 if h else 1
                for w in words:
                    counts[w] = counts.get(w, 0) + one
                ids.append(i)
                held.append(h)
                texts.append(b" ".join(words))
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield from _chunk_rows(chunk, ids, held, texts, counts, buckets)
                    chunk, ids, held, texts, counts, size = chunk + 1, [], [], [], {}, 0
        if ids:
            yield from _chunk_rows(chunk, ids, held, texts, counts, buckets)

    return run


# ---- step 2 ----------------------------------------------------------------------------------------------------------


def _slot(context: np.ndarray) -> np.ndarray:
    return (c.mix(context.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _sum(mixers: int):
    """Ask blobs of whole buckets to (mixer, strings with their sums) and to the sums of orders 1 and 2 (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0

        def reduced() -> None:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            first = c.run_starts(key[order])
            keys[:] = [key[order][first]]
            counts[:] = [np.add.reduceat(n[order], first) if len(first) else n]

        for batch in batches:
            for blob in batch.column("payload"):
                d, n = _unpacked(blob.as_py(), "<i8", "<u4")
                keys.append(np.cumsum(d))
                counts.append(n.astype(np.int64))
                held += len(d)
                if held > 1 << 22:  # strings that many chunks list shrink to one
                    reduced()
                    held = 0
        reduced()
        key, n = keys[0], counts[0]
        if not len(key):
            return
        mixer = _bucket(key >> 16 & 0xFFFFFF, mixers)
        order = np.argsort(mixer, kind="stable")
        bounds = np.r_[c.run_starts(mixer[order]), len(key)]
        blobs = [_packed(np.diff(key[order[i:j]], prepend=0), n[order[i:j]]) for i, j in zip(bounds[:-1], bounds[1:])]
        own = mixer[order[bounds[:-1]]]
        yield _rows(len(own), bucket=own.astype(np.int32), payload=blobs, n=np.diff(bounds))
        symbol, last = key >> 40, key >> 32 & 255
        # a slot's symbols are told apart by the tree as well, which the last byte picks
        low = np.concatenate([1 << 40 | last << 16 | last << 8 | symbol, 2 << 40 | _slot(key >> 24 & 0xFFFF) << 16 | last << 8 | symbol])
        code, unique = pd.factorize(low)
        sums = np.bincount(code, weights=np.tile(n, 2)).astype(np.int64)
        unique, sums = unique[sums > 0], sums[sums > 0]
        yield _rows(len(unique), chunk=unique, n=sums)

    return run


# ---- step 3 ----------------------------------------------------------------------------------------------------------


class Shared:
    """The trees and the counts of orders 1 and 2 that every mixer works with."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.order, self.where, self.last, self.symbol, self.n = key >> 40, key >> 16 & 0xFFFFFF, key >> 8 & 255, key & 255, n.astype(np.float32)
        pairs, first = np.zeros((256, 256)), self.order == 1
        np.add.at(pairs, (self.last[first], self.symbol[first]), n[first])
        overall = pairs.sum(0) + 1.0
        paths = [path for row in pairs + overall / overall.sum() for path in _tree(row)]
        self.size = np.array([len(p) for p in paths], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.node, self.bit = (np.array([step[k] for p in paths for step in p], np.int64) for k in (0, 1))
        self.tables = None

    def decisions(self, last: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, bit) of every decision of each row's symbol."""
        which = last << 8 | symbol
        size = self.size[which]
        row = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + self.start[which][row]
        return row, self.node[at], self.bit[at]

    def counts(self) -> dict[int, np.ndarray]:
        """Bit counts (zero and one by turns) of each order under (context, node), built once in a worker."""
        if self.tables is None:
            self.tables = {}
            for order, contexts in ((1, 1 << 8), (2, 1 << SLOT_BITS)):
                own = self.order == order
                row, node, bit = self.decisions(self.last[own], self.symbol[own])
                table = np.zeros(contexts << 9, np.float32)
                np.add.at(table, (self.where[own][row] << 8 | node) << 1 | bit, self.n[own][row])
                self.tables[order] = table
        return self.tables


def _tree(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """The (node, bit) path of each of 256 symbols in their Huffman tree."""
    heap = [(float(w), k, k) for k, w in enumerate(weights)]
    heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for node in range(255):
        low, high = heappop(heap), heappop(heap)
        up[low[2]], up[high[2]] = (node, 0), (node, 1)
        heappush(heap, (low[0] + high[0], 256 + node, 256 + node))
    paths = []
    for k in range(256):
        path, at = [], k
        while at in up:
            path.append(up[at])
            at = 256 + up[at][0]
        paths.append(path[::-1])
    return paths


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Predictors, weights and adaptive map for the strings of some 3-byte contexts."""

    def __init__(self, shared: Shared, grams: np.ndarray, counts: np.ndarray):
        """``grams``: all 6-byte strings of their contexts; ``counts``: how often the training documents have each."""
        self.last = grams >> 32 & 255
        self.row, node, self.bit = shared.decisions(self.last, grams >> 40)
        r = self.row
        self.last = self.last[r]
        self.weight = counts.astype(np.float32)[r]
        self.tables = dict(shared.counts())
        self.at = {1: (self.last << 8 | node) << 1, 2: (_slot(grams >> 24 & 0xFFFF)[r] << 8 | node) << 1}
        for order, context in ((3, grams >> 16 & 0xFFFFFF), (4, grams >> 8 & 0xFFFFFFFF), (5, grams & 0xFFFFFFFFFF)):
            cell, cells = pd.factorize((context << 8)[r] | node)
            self.at[order] = cell.astype(np.int64) << 1
            self.tables[order] = np.bincount(self.at[order] | self.bit, weights=self.weight, minlength=2 * len(cells)).astype(np.float32)
        self.mix = np.tile(np.array([0.0, 0.0, 0.05, 0.15, 0.35, 0.5], np.float32), (GATES, 1))
        self.map = np.zeros((256 * CELLS, 2), np.float32)

    def inputs(self, pick: np.ndarray, out: bool) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of a one by each predictor, gate); ``out`` takes the decision's own occurrence out of the counts."""
        odds, seen = np.empty((len(pick), 1 + ORDERS), np.float32), {}
        odds[:, 0] = 0.3
        one = self.bit[pick]
        own = (self.weight[pick] > 0).astype(np.float32) if out else np.float32(0)
        for k in range(1, 1 + ORDERS):
            at, table = self.at[k][pick], self.tables[k]
            n0, n1 = np.maximum(table[at] - own * (1 - one), 0), np.maximum(table[at | 1] - own * one, 0)
            odds[:, k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            seen[k] = n0 + n1
        level = lambda n, *steps: np.searchsorted(np.array(steps), n, "right")
        return odds, (level(seen[5], 1, 2, 5, 20) * 4 + level(seen[4], 1, 4, 30)) * 3 + level(seen[3], 3, 100)

    def _place(self, pick: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.last[pick] * CELLS + np.clip((x + 8) * 2, 0, CELLS - 1).astype(np.int64)

    def teach(self) -> None:
        """Weights and map from training decisions, batch by batch, in an order that mixes all contexts."""
        taught = np.flatnonzero(self.weight > 0)
        taught = taught[np.argsort(c.mix(taught.astype(np.uint64)), kind="stable")]
        momentum, few = np.zeros_like(self.mix), len(taught)
        steps = [(at, k) for k in reversed(range(min(PASSES, max(1, TEACH // max(1, few))))) for at in range(0, few, BATCH)]
        for at, left in steps:
            pick = taught[at : at + BATCH]
            odds, gate = self.inputs(pick, True)
            bit, w = self.bit[pick], self.weight[pick] ** 0.75
            x = np.einsum("ij,ij->i", odds, self.mix[gate])
            slope = ((bit - _squash(x)) * w)[:, None] * odds
            slope = np.stack([np.bincount(gate, slope[:, j], GATES) for j in range(1 + ORDERS)], 1)
            momentum = 0.8 * momentum + slope / (np.bincount(gate, w, GATES)[:, None] + 8)
            self.mix += (RATE * momentum).astype(np.float32)
            if not left:
                np.add.at(self.map, (self._place(pick, x), bit), w.astype(np.float32))

    def bits(self, step: int = 1 << 18) -> np.ndarray:
        """log2 of each string's last byte after its first five."""
        out = np.empty(len(self.row))
        for at in range(0, len(out), step):
            pick = np.arange(at, min(at + step, len(out)))
            odds, gate = self.inputs(pick, False)
            x = np.einsum("ij,ij->i", odds, self.mix[gate])
            p = np.clip(_squash(x), FLOOR, 1 - FLOOR)
            n = self.map[self._place(pick, x)]
            refined = (n[:, 1] + INERTIA * p) / (n.sum(1) + INERTIA)
            p = np.clip((p + refined) / 2, FLOOR, 1 - FLOOR)
            out[pick] = np.log2(np.where(self.bit[pick] == 1, p, 1 - p))
        return np.bincount(self.row, weights=out)


def _mix(shared, buckets: int):
    """A mixer's strings to (bucket, strings with log2 probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                held.setdefault(own, []).append(blob.as_py())
        for blobs in held.values():
            parts = [_unpacked(b, "<i8", "<i8") for b in blobs]
            key, n = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key)
            key, n = key[order], n[order]
            mixer = Mixer(shared.value, key, n)
            mixer.teach()
            bits = mixer.bits().astype(np.float32)
            order, bounds, own = _parts(key, buckets)
            out = [_packed(np.diff(key[order[i:j]], prepend=0), bits[order[i:j]]) for i, j in zip(bounds[:-1], bounds[1:])]
            yield _rows(len(own), kind=[_ODDS] * len(own), bucket=own.astype(np.int32), payload=out)

    return run


# ---- steps 4 and 5 -----------------------------------------------------------------------------------------------------


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets: each ask's strings get their probabilities, in the ask's order."""
    asks, odds = [], {}
    for batch in batches:
        for kind, chunk, bucket, blob in zip(*(batch.column(k).to_pylist() for k in ("kind", "chunk", "bucket", "payload"))):
            if kind == _ASKS:
                asks.append((bucket, chunk, blob))
            else:
                odds.setdefault(bucket, []).append(blob)
    asks.sort(key=lambda a: a[:2])
    now, key, bits = None, None, None
    for bucket, chunk, blob in asks:
        if bucket != now:
            parts = [_unpacked(b, "<i8", "<f4") for b in odds.pop(bucket)]
            key, bits = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(key)
            now, key, bits = bucket, key[order], bits[order]
        wanted = np.cumsum(_unpacked(blob, "<i8", "<u4")[0])
        yield _rows(1, kind=[_ODDS], chunk=[chunk], bucket=[bucket], payload=[_packed(bits[np.searchsorted(key, wanted)])])


def _scores(total: int, distinct: int, ends: int, buckets: int):
    """A chunk's documents from its texts, the probabilities of its strings, and the counts of its words."""

    def run(rows: pa.Table) -> pa.Table:
        at = rows["at"].to_numpy()
        chunk = rows.filter(pa.array(at == -1))["payload"][0].as_py()
        docs = pa.ipc.open_stream(chunk).read_all()
        texts = docs["text"].to_pylist()
        ids, held = docs["doc_id"], docs["held_out"]
        del docs, chunk
        known, seen_at = rows["value"].to_numpy()[at >= 0], at[at >= 0]
        place: dict[bytes, int] = {}
        lists = [np.array([place.setdefault(w, len(place)) for w in t.split()], np.int32) for t in texts]
        own = np.zeros(len(place), np.int64)
        del place
        own[seen_at] = known
        logs, whole = np.log10(own + 1.0), np.log10(total + distinct + 1.0)
        base = [float(logs[p].sum() + np.log10(ends + 1.0) - (len(p) + 1) * whole) for p in lists]
        seen = [int((own[p] > 0).sum()) + (ends > 0) for p in lists]
        answers = rows.filter(pa.array(at == -2)).sort_by("value")
        del rows
        keys = _strings(texts, np.ones(len(texts), bool))[0]
        given = np.empty(len(keys))
        given[_parts(keys, buckets)[0]] = np.concatenate([_unpacked(b.as_py(), "<f4")[0] for b in answers["payload"]])
        bits = []
        for at, end in _blocks(texts):
            data, starts, stops = _stream(texts[at:end])
            codes, unique = pd.factorize(_grams(data, 6))
            # strings at padding are in no list; theirs is never added
            each = given[np.minimum(np.searchsorted(keys, unique), len(keys) - 1)]
            upto = np.r_[0.0, np.cumsum(np.where(_inside(len(codes), starts, stops), each[codes], 0.0))]
            bits.append(upto[stops] - upto[starts])
        bits = np.concatenate(bits)
        sizes = np.array([len(t) + 1 for t in texts])
        return pa.table({
            "doc_id": ids, "held_out": held, "n_tokens": pa.array([len(p) + 1 for p in lists], pa.int64()), "n_known": pa.array(seen, pa.int64()),
            "train_tokens": pa.array([total] * len(texts), pa.int64()), "base_score": base, "score": bits * np.log10(2.0), "bits_per_byte": -bits / sizes,
        })

    return run


def _tidied(run):
    """``run`` for one group, after which the worker's free memory goes back to the system."""

    def tidied(rows: pa.Table) -> pa.Table:
        return next(c.tidy(lambda tables: map(run, tables))(iter([rows])))

    return tidied


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    # a 16 MB chunk lists some 2^19 strings; the sum of lengths is a scan of the column at the most
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(c.partitions(spark), -(-(size >> 5) // BUCKET_ROWS))
    measured = c.write_table(rows.mapInArrow(c.tidy(_read(buckets)), _ROW), "lm-chunks")
    kinds = {k: measured.where(F.col("kind") == k) for k in (_TEXTS, _ASKS, _WORDS)}
    mixers = max(1, -(-(size >> 7) // MIXER_ROWS))
    summed = c.write_table(kinds[_ASKS].select("bucket", "payload").repartition(buckets, "bucket").mapInArrow(c.tidy(_sum(mixers)), _ROW), "lm-strings")
    low = summed.where("payload is null").groupBy(F.col("chunk").alias("key")).agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast(Shared(low["key"].to_numpy().astype(np.int64), low["n"].to_numpy().astype(np.float64)))
    odds = summed.where("payload is not null").select("bucket", "payload").repartition(mixers, "bucket").mapInArrow(c.tidy(_mix(shared, buckets)), _ROW)
    odds = c.write_table(odds, "lm-odds")
    columns = ["kind", "chunk", "bucket", "payload"]
    answers = kinds[_ASKS].select(columns).unionByName(odds.select(columns)).repartition(buckets, "bucket").mapInArrow(c.tidy(_answer), _ROW)
    # a word has at most one row a chunk, so no window is larger than the number of chunks
    own = Window.partitionBy("word")
    words = kinds[_WORDS].select("chunk", "place", "n", F.sum("n").over(own).alias("value"), (F.row_number().over(own.orderBy("chunk")) == 1).alias("first"))
    words = c.write_table(words, "lm-words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("value") > 0)).alias("v")).head()
    ends = kinds[_TEXTS].agg(F.sum("n")).head()[0] or 0
    # at: a word's place in its chunk, -1 the texts, -2 the probabilities of a bucket's strings
    joined = kinds[_TEXTS].select("chunk", F.lit(-1).alias("at"), "payload", F.lit(0).cast("long").alias("value"))
    joined = joined.unionByName(answers.select("chunk", F.lit(-2).alias("at"), "payload", F.col("bucket").cast("long").alias("value")))
    joined = joined.unionByName(words.select("chunk", F.col("place").alias("at"), F.lit(None).cast("binary").alias("payload"), "value"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return joined.groupBy("chunk").applyInArrow(_tidied(_scores(int(sums["n"]) + ends, sums["v"] + (ends > 0), ends, buckets)), schema)
