"""N-gram Jaccard self-join: exact links between shingle sets, and the groups that links form.

Method, in three steps:

1. *Index lists by parts.* Linked sets of a size level differ in a bounded number of shingles, so of one part more than
   that, dealt out by hash, one is the same in both (``signatures``). Sets are listed by the contents of their parts: some
   five shingles each, which sets that share a passage seldom have in common, however large the input. Shingles that
   counters over all documents call common stay out where that loses nothing. Linked sets agree in several parts, so
   only pairs that meet in as many lists count; members of long lists point to one leader. The connected clusters of
   both contain every link.
2. *Exact join inside clusters* (``join_cell``): inverted lists of the rarest shingles, ordered by position and cut
   off where the position leaves too few shingles for a link; and a set that is highly similar to the set before it
   derives all of its overlaps from that set's computed overlaps, reading only the lists of shingles that differ.
   Clusters of more than ``BLOCK`` sets or ``MASS`` shingles are joined block by block, so that a cell's memory is
   bounded however long the texts are; only a single set larger than that is a block of its own.
3. Components of the links.

Defined cases: null or empty text: the set is empty and links with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Rows with a null doc_id take part; a group of such rows alone has a null component_id.
Repeated rows are equal sets and so one group. A text of any length is one set. Empty table: empty result. Other
columns are not read; ``keep_one`` passes them on, whatever their names. Sets are told apart by 128-bit hashes, and
named by 64 bits of them in the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c
from inkledger.llm.components import components
from inkledger.llm.repeats import grown, ragged

SIG = [("sig", "<u8"), ("node", "<u8")]
#: The bits of a list's name that tell its scheme, and the members of a list from which on it has a leader instead of pairs.
SCHEME_BITS, LONG = np.uint64(63), 32
#: Pairs that a task puts together at a time.
PAIRS = 1 << 20
SET = [("root", "<i8"), ("scheme", "<u4"), ("i", "<u4"), ("j", "<u4"), ("hi", "<u8"), ("lo", "<u8"), ("copies", "<i8"), ("part", "<u4"), ("size", "<u4")]
BLOCK = 1 << 14
#: Shingles of a block, and cell tasks for each shuffle partition: a cell needs about ten times its shingles in memory.
MASS, CELL_SPLIT = 1 << 21, 4
#: Bytes of text whose sets are shipped together: near copies among them compress.
SHIP_BYTES = 1 << 22
#: Counters of shingle frequencies, and the slices in which tasks add them up.
COUNTER_BITS, SLICES = 24, 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, sorted by row and hash."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    starts, ends, owner = c.words_of(low, offsets)
    symbols = c.word_hashes(low, starts, ends)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    count = np.diff(cuts)
    rolling = c.Rolling(symbols, 1)
    take = np.where(count >= q, count - q + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), take)
    first = cuts[row] + ragged(np.zeros(len(count), np.int64), take)
    width = np.where(count >= q, q, count)[row]
    value = c.mix(rolling.stretch(first, first + width) + width.astype(np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    once = c.run_starts(row, value)
    return row[once], value[once]


def names(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, high, low name) of each row's set."""
    size = np.bincount(row, minlength=rows)
    hi, lo = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(row):
        at = c.run_starts(row)
        hi[row[at]] = np.add.reduceat(c.mix(value ^ np.uint64(0x5851F42D4C957F2D)), at)
        lo[row[at]] = np.add.reduceat(c.mix(value), at)
    return size, c.mix(hi + size.astype(np.uint64)), c.mix(lo ^ (size.astype(np.uint64) << np.uint64(32)))


def levels(num: int, den: int, most: int = 1 << 31) -> np.ndarray:
    """Largest set size of each size level: sets linked to each other lie in one level or in neighbours."""
    tops, top = [1], 1
    while top < most:
        top = max(top + 1, (top + 1) * den * den // (num * num))
        tops.append(top)
    return np.array(tops)


def counted(value: np.ndarray) -> np.ndarray:
    """Each shingle's counter."""
    return (value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for i, j, data, offsets in c.text_chunks(batch):
                row, value = shingle_sets(data, offsets, q)
                _, _, lo = names(row, value, j - i)
                keep = np.zeros(j - i, bool)
                keep[np.unique(lo, return_index=True)[1]] = True  # one of each group of copies
                at, n = np.unique(counted(value[keep[row]]), return_counts=True)
                table[at] += n.astype(np.uint32)
        if table.any():
            blobs = [pa.Codec("zstd", 1).compress(part.tobytes(), asbytes=True) for part in np.split(table, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

    return run


def _levels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the tasks' counters slice by slice; a quarter of a doubling is one level."""
    width, total = (1 << COUNTER_BITS) // SLICES, {}
    for batch in batches:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            part = np.frombuffer(pa.Codec("zstd").decompress(blob.as_py(), width * 4, asbytes=True), np.uint32)
            total[k] = total.get(k, 0) + part.astype(np.float64)
    blobs = [np.floor(4 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])


def rarity(docs: DataFrame, q: int) -> np.ndarray:
    """How frequent the shingles of each counter are over all documents: 16 MB, whatever the input.

    Shingles that share a counter share its level. The levels only tell which shingles stay out of parts; a coarse count
    costs candidates and never a link.
    """
    sums = c.exchange(docs.mapInArrow(c.tidy(_count(q)), c.PACKED), min(SLICES, c.partitions(docs.sparkSession))).mapInArrow(c.tidy(_levels_of), c.PACKED)
    out = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), np.uint8)
    for k, blob in sums.collect():
        out[k] = np.frombuffer(blob, np.uint8)
    return out.ravel()


def spares(num: int, den: int, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(far, spare, need) of each scheme: the shingles in which linked sets differ at most, the parts without shingles that a set
    may have, and the parts with shingles in which linked sets then agree.

    There are far + spare + need parts. ``spare`` covers those that chance leaves empty in a scheme's smallest sets, as long as it is
    at most half of ``far``: sets with more empty parts list all of their parts again.
    """
    far = 2 * tops * (den - num) // (den + num)
    need, least = 1 + far // 16, np.r_[0, tops[:-1]] * num // den + 1
    found = np.where(far > 0, far // 16 + 2, 0)
    for share in range(32, 3, -1):
        spare = far * share // 64 + 2
        parts = far + spare + need
        empty = parts * np.exp(-least / parts)
        found = np.where((far > 0) & (empty + 1.5 * np.sqrt(empty) <= spare), spare, found)
    return far, found, need


def signatures(row: np.ndarray, value: np.ndarray, size: np.ndarray, rare: np.ndarray, num: int, den: int, tops: np.ndarray, common: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, scheme) of each set's parts; a set takes its level's scheme and, if larger linked sets can lie there, the next one's.

    Linked sets of a scheme differ in at most ``far`` shingles. Dealt out by hash to ``far`` + ``spare`` + ``need`` parts, they agree in
    ``need`` parts that have shingles, unless both have more than ``spare`` parts without. Common shingles are left out first, for
    parts within a passage that many documents share would be lists of them all; sets with too many parts without then list parts
    of all their shingles, and those that have too many even so list ``far`` + ``need`` parts, with or without shingles.
    The last bits of a list's name are its scheme.
    """
    level, up, own = np.searchsorted(tops, size), climbs(size, num, den, tops), np.flatnonzero(size > 0)
    who, scheme = np.r_[own, own[up[own]]], np.r_[level[own], level[own[up[own]]] + 1].astype(np.int64)
    far, spare, need = (x[scheme] for x in spares(num, den, tops))
    salt = c.mix(scheme.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    begin, end = (np.searchsorted(row, who, side) for side in ("left", "right"))
    usual = rare[counted(value)] < (common_level(rare) if common is None else common)
    lists: list[tuple[np.ndarray, ...]] = []

    def parts(take: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
        """List the parts of some sets; how many parts of each have shingles."""
        first = np.r_[0, np.cumsum(count)]
        length = end[take] - begin[take]
        at, of = ragged(begin[take], length), np.repeat(np.arange(len(take)), length)
        if kind == 1:
            at, of = at[usual[at]], of[usual[at]]
        mixed = c.mix(value[at] ^ salt[take][of])
        spot = first[of] + ((mixed >> np.uint64(32)).astype(np.int64) * count[of] >> 32)
        order = np.argsort(spot, kind="stable")
        starts = c.run_starts(spot[order])
        full = spot[order][starts]
        content = c.mix(np.add.reduceat(c.mix(mixed[order]), starts)) if len(starts) else np.zeros(0, np.uint64)
        if kind == 3:
            every = np.zeros(first[-1], np.uint64)
            every[full] = content
            full, content = np.arange(first[-1]), every
        of = np.searchsorted(first, full, "right") - 1
        name = c.mix(content ^ c.mix(salt[take][of] + ((full - first[of]) * 4 + kind).astype(np.uint64)))
        lists.append((who[take][of], name & ~SCHEME_BITS | scheme[take][of].astype(np.uint64), scheme[take][of]))
        return np.bincount(of, minlength=len(take))

    take = np.arange(len(who))
    for kind in (1, 2):
        count = (far + spare + need)[take]
        take = take[count - parts(take, count, kind) > spare[take]]
    parts(take, (far + need)[take], 3)
    return tuple(np.concatenate(x) for x in zip(*lists))


def climbs(size: np.ndarray, num: int, den: int, tops: np.ndarray) -> np.ndarray:
    """Whether a larger linked set can lie in the next level."""
    return size * den // num > tops[np.searchsorted(tops, size)]


def common_level(rare: np.ndarray) -> int:
    """The level from which a shingle is common: 32 and twice the mean of all counters."""
    mean = np.exp2(np.arange(256) / 4) - 1
    return int(np.ceil(4 * np.log2(33 + 2 * (np.bincount(rare, minlength=256) @ mean) / len(rare))))


def node_of(lo: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    """A set's name within one size scheme; clusters are made scheme by scheme, so sizes do not chain."""
    return c.mix(lo + scheme.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _describe(q: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = levels(num, den)
        for batch in batches:
            for i, j, data, offsets in c.text_chunks(batch):
                size, hi, lo = names(*shingle_sets(data, offsets, q), j - i)
                level = np.searchsorted(tops, size)
                nodes = [node_of(lo, level + up).view(np.int64) for up in (0, 1)]
                cols = [batch.column("doc_id")[i:j], batch.column("ver")[i:j], pa.array(size, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))]
                cols += [pa.array(level, pa.int32()), pa.array(nodes[0]), pa.array(nodes[1], mask=~climbs(size, num, den, tops))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ver", "n_shingles", "hi", "lo", "level", "node", "node_up"])

    return run


def _sign(q: int, num: int, den: int, buckets: int, rare: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, tops, common = c.Packer(SIG, buckets), levels(num, den), common_level(rare)
        for batch in batches:
            for i, j, data, offsets in c.text_chunks(batch):
                row, value = shingle_sets(data, offsets, q)
                size, _, lo = names(row, value, j - i)
                _, one = np.unique(lo, return_index=True)  # one of each group of copies
                keep = np.zeros(j - i, bool)
                keep[one] = True
                pick = keep[row]
                r, sig, scheme = signatures(row[pick], value[pick], np.where(keep, size, 0), rare, num, den, tops, common)
                yield from out.add(sig, sig, node_of(lo[r], scheme))
        yield from out.flush()

    return run


def _meetings(num: int, den: int):
    """Pairs of sets with the number of lists in which a task sees them meet, and how many it takes; 0 for a long list's leader and a member."""
    needs = spares(num, den, levels(num, den))[2]

    def batch(a: np.ndarray, b: np.ndarray, lists: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(lists, pa.int32()), pa.array(need, pa.int32())], names=["a", "b", "lists", "need"])

    def fold(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((x["node"], x["sig"]))
        s, v = x["sig"][order], x["node"][order]
        once = c.run_starts(s, v)
        s, v = s[once], v[once]
        at = c.run_starts(s)
        size = np.diff(np.r_[at, len(s)])
        place = np.arange(len(s)) - np.repeat(at, size)
        far = np.repeat(size > LONG, size) & (place > 0)
        keep = place <= LONG
        return {"sig": s[keep], "node": v[keep]}, (np.repeat(v[at], size)[far], v[far])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for led, held in grown(batches, SIG, fold):
            if led is not None and len(led[0]):
                pairs = np.unique(np.c_[led], axis=0)
                yield batch(pairs[:, 0].copy(), pairs[:, 1].copy(), np.ones(len(pairs)), np.zeros(len(pairs)))
        if held is None:
            return
        s, v = held["sig"], held["node"]
        at = c.run_starts(s)
        size = np.diff(np.r_[at, len(s)])
        several = (size > 1) & (size <= LONG)
        at, size = at[several], size[several]
        end = np.cumsum(size * (size - 1) // 2)
        first = 0
        while first < len(at):  # some lists at a time
            last = max(first + 1, int(np.searchsorted(end, (end[first - 1] if first else 0) + PAIRS, "right")))
            own = ragged(at[first:last], size[first:last])
            after = np.repeat(at[first:last] + size[first:last], size[first:last]) - own - 1
            a, b = np.repeat(own, after), ragged(own + 1, after)
            need, a, b = needs[(s[a] & SCHEME_BITS).astype(np.int64)], v[a], v[b]
            order = np.lexsort((b, a))
            need, a, b = need[order], a[order], b[order]
            once = c.run_starts(a, b)
            yield batch(a[once], b[once], np.diff(np.r_[once, len(a)]), need[once])
            first = last

    return run


def _ship(q: int, buckets: int):
    """Cut the sets of cluster members from their texts and deal them out by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, scheme, parts, part, copies = (c.column(batch, k) for k in ("root", "scheme", "parts", "part", "copies"))
            for b0, b1, data, offsets in c.text_chunks(batch, limit=SHIP_BYTES):
                row, value = shingle_sets(data, offsets, q)
                size, hi, lo = names(row, value, b1 - b0)
                at = np.searchsorted(row, np.arange(b1 - b0 + 1))
                n, own = parts[b0:b1], part[b0:b1]
                rep = np.repeat(np.arange(b1 - b0), n)
                other = ragged(np.zeros(len(n), np.int64), n)
                i, j = np.minimum(own[rep], other), np.maximum(own[rep], other)
                bucket = c.mix(root[b0:b1][rep].astype(np.uint64) ^ c.mix((i << 32 | j).astype(np.uint64))) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                rep, i, j, bucket = rep[order], i[order], j[order], bucket[order].astype(np.int32)
                cols = dict(root=root[b0:b1][rep], scheme=scheme[b0:b1][rep], i=i, j=j, hi=hi[rep], lo=lo[rep], copies=copies[b0:b1][rep], part=own[rep], size=size[rep])
                edge = np.r_[c.run_starts(bucket), len(bucket)]
                blobs = [np.int64(b - a).tobytes() + b"".join(cols[k][a:b].astype(kind).tobytes() for k, kind in SET) + pa.compress(value[ragged(at[rep[a:b]], size[rep[a:b]])].tobytes(), "zstd", asbytes=True) for a, b in zip(edge, edge[1:])]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

    return run


class Cell:
    """The sets of one cluster (or of two blocks of a large one) with inverted lists in rare-first order."""

    def __init__(self, size: np.ndarray, value: np.ndarray, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        order = np.argsort(value)
        new = np.empty(len(value), bool)
        new[:1] = True
        ordered = value[order]
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        del ordered
        seen = np.diff(np.r_[np.flatnonzero(new), len(value)])
        rank = np.empty(len(seen), np.int32)
        rank[np.argsort(seen, kind="stable")] = np.arange(len(seen), dtype=np.int32)
        token = np.empty(len(value), np.int32)
        token[order] = rank[np.cumsum(new, dtype=np.int32) - 1]
        del order, new
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        key = owner.astype(np.int64) << 32 | token
        key.sort()
        self.token = (key & 0xFFFFFFFF).astype(np.int32)  # each set's shingles, rarest first
        del key, token
        place = (np.arange(len(owner)) - self.begins[owner]).astype(np.int32)
        order = np.argsort(self.token.astype(np.int64) << 32 | place)
        self.list_set, self.list_place = owner[order], place[order]
        self.list_at = np.r_[0, np.cumsum(seen[np.argsort(seen, kind="stable")])]
        self.prefix = size - (size * num + den - 1) // den + 1
        self.mark = np.zeros(len(self.list_at), np.int8)

    def of(self, k: int) -> np.ndarray:
        return self.token[self.begins[k] : self.ends[k]]

    def linked(self, k: int, others: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return overlap * self.den >= self.num * (self.size[k] + self.size[others] - overlap)

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """With every set, by whole lists."""
        lists = ragged(self.list_at[tokens], self.list_at[tokens + 1] - self.list_at[tokens])
        return np.bincount(self.list_set[lists], minlength=len(self.size))

    def skipping(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of set ``k`` and their overlaps by prefix lists; a list is left at the first position from which no link can follow."""
        own, found = self.of(k), []
        for i, t in enumerate(own[: self.prefix[k]].tolist()):
            a, b = self.list_at[t], self.list_at[t + 1]
            if b - a < 2:
                continue
            most = self.prefix[k] * self.den // self.num + 1  # no linked set has a longer prefix
            b = a + np.searchsorted(self.list_place[a:b], most, "right")
            sets, place = self.list_set[a:b], self.list_place[a:b]
            room = 1 + np.minimum(self.size[k] - i - 1, self.size[sets] - place - 1)
            found.append(sets[room * (self.den + self.num) >= self.num * (self.size[k] + self.size[sets])])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.unique(np.concatenate(found))
        maybe = maybe[(self.size[maybe] * self.den >= self.num * self.size[k]) & (self.size[maybe] * self.num <= self.den * self.size[k]) & (maybe != k)]
        if not len(maybe):
            return maybe, maybe
        self.mark[own] = 1
        inside = self.mark[self.token[ragged(self.begins[maybe], self.size[maybe])]]
        self.mark[own] = 0
        overlap = np.add.reduceat(inside, np.cumsum(self.size[maybe]) - self.size[maybe], dtype=np.int64)
        hit = self.linked(k, maybe, overlap)
        return maybe[hit], overlap[hit]

    def answers(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(set, linked sets, overlaps with them) for every set, neighbours in content after one another."""
        before, overlap = -1, None
        for k in np.lexsort((self.size, self.token[self.begins])).tolist():
            own = self.of(k)
            if before >= 0:
                last = self.of(before)
                lost, gained = np.setdiff1d(last, own, True), np.setdiff1d(own, last, True)
                if len(lost) + len(gained) <= len(own) // 2:
                    if overlap is None:
                        overlap = self.overlaps(last)
                    overlap = overlap - self.overlaps(lost) + self.overlaps(gained)
                    hit = np.flatnonzero(self.linked(k, np.arange(len(self.size)), overlap))
                    before = k
                    hit = hit[hit != k]
                    yield k, hit, overlap[hit]
                    continue
            before, overlap = k, None
            yield k, *self.skipping(k)


def join_cell(size: np.ndarray, value: np.ndarray, copies: np.ndarray, side: np.ndarray | None, num: int, den: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(group label, number of linked documents) of each set.

    With sides given, only links across sides count; a link counts in the scheme of its larger set, which has more than ``least`` shingles.
    """
    cell, n = Cell(size.astype(np.int64), value, num, den), len(size)
    label, links = np.arange(n), np.zeros(n, np.int64)
    for k, hit, _ in cell.answers():
        hit = hit[np.maximum(size[hit], size[k]) > least]
        if side is not None:
            hit = hit[side[hit] != side[k]]
        links[k] = copies[hit].sum()
        groups = np.unique(label[np.r_[hit, k]])
        if len(groups) > 1:
            label[np.isin(label, groups[1:])] = groups[0]
    return label, links


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray | None]]:
    """(sets, their shingles, side of each set in a cell of two blocks) of a task's cells.

    Only the cell at hand is put together; its sets lie in several blobs.
    """
    fixed = sum(np.dtype(k).itemsize for _, k in SET)
    blobs, cols = [], []
    for batch in batches:
        for blob in batch.column("payload"):
            blob = blob.as_py()
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            own = c.unpack(SET, blob[8 : 8 + n * fixed])
            size = own["size"].astype(np.int64)
            cols.append(own | {"blob": np.full(n, len(blobs)), "at": np.cumsum(size) - size})
            blobs.append(np.frombuffer(pa.decompress(blob[8 + n * fixed :], 8 * int(size.sum()), "zstd"), np.uint64))
    if not cols:
        return
    x = {k: np.concatenate([y[k] for y in cols]) for k in cols[0]}
    cols.clear()
    x["size"] = x["size"].astype(np.int64)
    order = np.lexsort((x["lo"], x["hi"], x["j"], x["i"], x["root"]))
    order = order[c.run_starts(*(x[k][order] for k in ("root", "i", "j", "hi", "lo")))]
    edges = np.r_[c.run_starts(*(x[k][order] for k in ("root", "i", "j"))), len(order)]
    for s, e in zip(edges, edges[1:]):
        own = order[s:e]
        i, j = int(x["i"][own[0]]), int(x["j"][own[0]])
        value = np.concatenate([blobs[x["blob"][k]][x["at"][k] : x["at"][k] + x["size"][k]] for k in own])
        yield {k: v[own] for k, v in x.items()}, value, None if i == j else x["part"][own] == j


def _join(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [0, *levels(num, den).tolist()]
        a, b, count, ready = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (a, b, count)], names=["a", "b", "links"])

        for x, value, side in _cells(batches):
            label, links = join_cell(x["size"], value, x["copies"], side, num, den, floors[x["scheme"][0]])
            node = x["lo"].view(np.int64)
            a.append(node), b.append(node[label]), count.append(links)
            ready += len(node)
            if ready > c.CHUNK_BYTES:
                yield flush()
                a, b, count, ready = [], [], [], 0
        if ready:
            yield flush()

    return run


def _pairs(num: int, den: int):
    """Each link once, with the sizes of both sets and their overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = [0, *levels(num, den).tolist()]
        held, ready = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*held)], names=["a", "b", "na", "nb", "overlap"])

        for x, value, side in _cells(batches):
            size, node, least = x["size"], x["lo"].view(np.int64), floors[x["scheme"][0]]
            for k, hit, overlap in Cell(size, value, num, den).answers():
                take = (hit > k) & (np.maximum(size[hit], size[k]) > least)
                if side is not None:
                    take &= side[hit] != side[k]
                hit, n = hit[take], int(take.sum())
                if n:
                    held.append((np.full(n, node[k]), node[hit], np.full(n, size[k]), size[hit], overlap[take].astype(np.int64)))
                    ready += n
                if ready > c.CHUNK_BYTES // 4:
                    yield flush()
                    held, ready = [], 0
        if ready:
            yield flush()

    return run


def describe(docs: DataFrame, q: int, num: int, den: int) -> DataFrame:
    """doc_id, ver, n_shingles, the set's name (hi, lo) and its nodes in its size schemes, as a table."""
    key = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.mapInArrow(c.tidy(_describe(q, num, den)), f"doc_id {key}, ver long, n_shingles long, hi long, lo long, level int, node long, node_up long")
    return c.write_table(sets, "jaccard-sets")


def cells_of(docs: DataFrame, sets: DataFrame, q: int, num: int, den: int, block: int = BLOCK, mass: int = MASS) -> DataFrame:
    """The sets of clusters that hold every link, dealt out by cell."""
    buckets = c.partitions(docs.sparkSession)
    lists = c.exchange(docs.mapInArrow(c.tidy(_sign(q, num, den, buckets, rarity(docs, q))), c.PACKED), buckets)
    met = lists.mapInArrow(c.tidy(_meetings(num, den)), "a long, b long, lists int, need int").groupBy("a", "b")
    near = c.write_table(met.agg(F.sum("lists").alias("lists"), F.min("need").alias("need")).where("lists >= need").select("a", "b"), "jaccard-near")
    clusters = components(near, "jaccard-clusters")
    one = sets.where("n_shingles > 0").groupBy("hi", "lo", "level", "node", "node_up").agg(F.min(F.struct("doc_id", "ver")).alias("one"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("size"))
    up = F.struct((F.col("level") + 1).alias("scheme"), F.col("node_up").alias("node"))
    spots = F.array_compact(F.array(F.struct(F.col("level").alias("scheme"), "node"), F.when(F.col("node_up").isNotNull(), up)))
    spread = one.select("hi", "lo", "one", "copies", "size", F.inline(spots))
    member = spread.join(clusters, "node").select("root", "scheme", "hi", "copies", "size", "one.doc_id", "one.ver")
    member = c.write_table(member, "jaccard-members")
    width = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / mass)).alias("parts"))
    member = member.join(width, "root").select("doc_id", "ver", "root", "scheme", "copies", "parts", F.pmod("hi", "parts").alias("part"))
    d, m = docs.alias("d"), member.alias("m").hint("shuffle_hash")
    texts = d.join(m, F.expr("d.doc_id <=> m.doc_id and d.ver = m.ver")).select("d.text", "m.root", "m.scheme", "m.copies", "m.parts", "m.part")
    return c.exchange(texts.mapInArrow(c.tidy(_ship(q, buckets * CELL_SPLIT)), c.PACKED), buckets * CELL_SPLIT)


def link_groups(docs: DataFrame, sets: DataFrame, q: int, num: int, den: int, block: int = BLOCK, mass: int = MASS) -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked sets' groups, and (node, links): how many documents with another set it links with."""
    cells = cells_of(docs, sets, q, num, den, block, mass)
    linked = c.write_table(cells.mapInArrow(c.tidy(_join(num, den)), "a long, b long, links long"), "jaccard-links")
    groups = components(linked, "jaccard-groups")
    return groups, linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))


def set_links(docs: DataFrame, sets: DataFrame, q: int, num: int, den: int, block: int = BLOCK, mass: int = MASS) -> DataFrame:
    """(a, b, na, nb, overlap): each pair of linked sets once, by their names ``lo``, with their sizes."""
    cells = cells_of(docs, sets, q, num, den, block, mass)
    return c.write_table(cells.mapInArrow(c.tidy(_pairs(num, den)), "a long, b long, na long, nb long, overlap long"), "jaccard-pairs")


def labelled(docs: DataFrame, q: int, num: int, den: int, block: int = BLOCK, mass: int = MASS) -> DataFrame:
    """The columns of ``jaccard_groups`` and ``class``, which names a row's group; null for an empty set."""
    base = c.docs_with_version(docs)
    sets = describe(base, q, num, den)
    groups, links = link_groups(base, sets, q, num, den, block, mass)
    about = groups.join(links, "node", "full").select(F.col("node").alias("lo"), F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    one = sets.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    one = one.join(about, "lo", "left").withColumn("class", F.coalesce("root", "lo"))
    one = c.write_table(one, "jaccard-classes")
    least = one.groupBy("class").agg(F.min("least").alias("component"))
    label = one.join(least, "class").select("hi", "lo", "class", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("near"))
    full = F.col("n_shingles") > 0
    return sets.join(label, ["hi", "lo"], "left").select("doc_id", "ver", "n_shingles", F.when(full, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(full, F.col("near")).otherwise(F.lit(0)).cast("long").alias("n_links"), "class")


def jaccard_groups(docs: DataFrame, q: int = 4, num: int = 85, den: int = 100, block: int = BLOCK, mass: int = MASS) -> DataFrame:
    """doc_id, ver, n_shingles, component_id, n_links of every row; sets link at intersection * den >= num * union."""
    return labelled(docs, q, num, den, block, mass).drop("class")


def keep_one(docs: DataFrame, q: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group, the first by doc_id (null last) and text version; empty documents all stay."""
    groups = c.write_table(labelled(docs, q, num, den), "jaccard-keep")
    each = groups.where("n_shingles > 0").groupBy("class", "doc_id", "ver").agg(F.count(F.lit(1)).alias("rows_"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ver", "rows_")).alias("one")
    full = each.groupBy("class").agg(first).select("one.doc_id", "one.ver", F.col("class").alias("class_"), "one.rows_")
    bare = groups.where("n_shingles = 0").select("doc_id", "ver").distinct().select("doc_id", "ver", F.lit(None).cast("long").alias("class_"), F.lit(1).cast("long").alias("rows_"))
    text = F.coalesce("text", F.lit(""))
    d, s = docs.select(c.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("ver")).alias("d"), full.unionByName(bare).alias("s").hint("shuffle_hash")
    kept = d.join(s, F.expr("d.doc_id <=> s.doc_id and d.ver = s.ver")).select("d.row", "class_", "rows_")
    single = kept.where("rows_ = 1").select("row.*")
    repeated = kept.where("rows_ > 1").dropDuplicates(["class_"]).select("row.*")
    return single.unionByName(repeated)
