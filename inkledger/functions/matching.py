"""The standard library's sequence matching, with the same blocks, on long sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from difflib import Match
from difflib import SequenceMatcher as Plain
from heapq import heappop, heappush

import numpy as np

#: Pairs of equal places from which all runs are found at once; pairs and runs held at a time; runs looked at one by one.
MANY, PAIRS, RUNS, FEW = 1 << 10, 1 << 20, 1 << 18, 64


class SequenceMatcher(Plain):
    """Looks only at the places whose element counts in the other sequence, and only within the stretch at hand.

    The library's search walks over every place of a stretch and over each element's whole list of places, once for every block.
    Here the runs of equal places are found once, longest first, and cut where blocks that were found before end them. No
    junk rule but the automatic one is supported.
    """

    def __init__(self, a, b):
        super().__init__(None, a, b)
        self.places = [i for i, x in enumerate(a) if x in self.b2j]

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b, b2j, places = self.a, self.b, self.b2j, self.places
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        at_a, at_b, size = alo, blo, 0
        runs, last = {}, -1
        for i in places[bisect_left(places, alo) : bisect_left(places, ahi)]:
            get = runs.get if i == last + 1 else {}.get
            last, runs = i, {}
            own = b2j[a[i]]
            for j in own[bisect_left(own, blo) : bisect_left(own, bhi)] if len(own) > 4 else own:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = runs[j] = get(j - 1, 0) + 1
                if k > size:
                    at_a, at_b, size = i - k + 1, j - k + 1, k
        return Match(*self._grown(at_a, at_b, size, alo, ahi, blo, bhi))

    def _grown(self, i, j, k, alo, ahi, blo, bhi):
        """The block with the equal places at its ends, which common elements may be."""
        a, b = self.a, self.b
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return i, j, k

    def get_matching_blocks(self):
        if self.matching_blocks is None and sum(len(self.b2j[self.a[i]]) for i in self.places) > MANY:
            self.matching_blocks = self._joined(sorted(self._blocks()))
        return super().get_matching_blocks()

    def _joined(self, blocks):
        """Blocks that touch as one, and an empty one at the end."""
        out, i, j, k = [], 0, 0, 0
        for x, y, n in blocks:
            if i + k == x and j + k == y:
                k += n
            else:
                if k:
                    out.append(Match(i, j, k))
                i, j, k = x, y, n
        if k:
            out.append(Match(i, j, k))
        return [*out, Match(len(self.a), len(self.b), 0)]

    def _blocks(self):
        """Blocks in the order of their runs' lengths: the longest run left is that of the stretch it lies in."""
        n, m = len(self.a), len(self.b)
        codes = {x: c for c, x in enumerate(self.b2j)}
        code_a, code_b = np.full(n + 1, -1, np.int64), np.full(m + 1, -2, np.int64)
        for i in self.places:
            code_a[i] = codes[self.a[i]]
        for x, js in self.b2j.items():
            code_b[js] = codes[x]
        places = np.array(self.places, np.int64)
        counted = np.flatnonzero(code_b >= 0)
        by_code = np.sort(code_b[counted] * (m + 1) + counted)
        blocks: list[tuple[int, int, int]] = []
        stretches = [(0, n, 0, m)]
        while stretches:
            runs, whole = self._runs(code_a, code_b, places, by_code, stretches)
            if not len(runs[0]):
                break
            stretches = self._cut(runs, whole, stretches, blocks)
        for s in stretches:
            i, j, k = self._grown(s[0], s[2], 0, *s)
            if k:
                blocks.append((i, j, k))
        return blocks

    @staticmethod
    def _runs(code_a, code_b, places, by_code, stretches):
        """(length, i, j) of the runs within stretches, longest first, then by place; whether these are all of them."""
        alo, ahi, blo, bhi = np.array(stretches, np.int64).T
        own = np.searchsorted(alo, places, "right") - 1
        inside = (own >= 0) & (places < ahi[own])
        at, own = places[inside], own[inside]
        base = code_a[at] * len(code_b)
        low, high = np.searchsorted(by_code, base + blo[own]), np.searchsorted(by_code, base + bhi[own])
        upto = np.cumsum(high - low)
        held, whole, start = [np.zeros(0, np.int64)] * 3, True, 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            n = (high - low)[start:end]
            i, s = np.repeat(at[start:end], n), np.repeat(own[start:end], n)
            j = by_code[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(low[start:end], n)] % len(code_b)
            first = (i == alo[s]) | (j == blo[s]) | (code_a[i - 1] != code_b[j - 1])
            i, j, s = i[first], j[first], s[first]
            most, size = np.minimum(ahi[s] - i, bhi[s] - j), np.ones(len(i), np.int64)
            going = np.arange(len(i))
            while len(going):
                k = size[going]
                going = going[(k < most[going]) & (code_a[i[going] + k] == code_b[j[going] + k])]
                size[going] += 1
            held = [np.concatenate(x) for x in zip(held, (size, i, j))]
            if len(held[0]) > RUNS or end >= len(at):
                order = np.lexsort((held[2], held[1], -held[0]))
                whole = whole and len(order) <= RUNS
                held = [x[order[:RUNS]] for x in held]
            start = end
        return held, whole

    def _cut(self, runs, whole, stretches, blocks):
        """Takes each run that is whole within its stretch as a block; the stretches left."""
        last = (-int(runs[0][-1]), int(runs[1][-1]), int(runs[2][-1]))
        starts = [s[0] for s in stretches]
        parts: list[tuple[int, int, int]] = []  # of runs that blocks cut
        at, step = 0, FEW

        def take(k, i, j):
            """Cuts the stretch about the run, or puts what lies within stretches among the parts."""
            p = max(0, bisect_right(starts, i) - 1)
            if p < len(starts):
                alo, ahi, blo, bhi = s = stretches[p]
                if alo <= i and i + k <= ahi and blo <= j and j + k <= bhi:
                    i, j, k = block = self._grown(i, j, k, *s)
                    blocks.append(block)
                    left = [x for x in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if x[0] < x[1] and x[2] < x[3]]
                    stretches[p : p + 1] = left
                    starts[p : p + 1] = [x[0] for x in left]
                    return
            while p < len(starts) and starts[p] < i + k:
                alo, ahi, blo, bhi = stretches[p]
                skip = max(0, alo - i, blo - j)
                size = min(k, ahi - i, bhi - j) - skip
                if size > 0:
                    part = (-size, i + skip, j + skip)
                    if whole or part <= last:
                        heappush(parts, part)
                p += 1

        while at < len(runs[0]) and stretches:
            size, i, j = (x[at : at + step] for x in runs)
            alo, ahi, blo, bhi = np.array(stretches, np.int64).T
            p = np.maximum(np.searchsorted(alo, i, "right") - 1, 0)
            q = np.maximum(np.searchsorted(alo, i + size - 1, "right") - 1, 0)  # the last stretch that a run meets
            hit = (q > p) | ((i < ahi[p]) & (i + size > alo[p]) & (j < bhi[p]) & (j + size > blo[p]))
            found = np.flatnonzero(hit)
            seen = found[FEW - 1] + 1 if len(found) > FEW else len(i)
            found = found[found < seen]
            for k, x, y in zip(size[found].tolist(), i[found].tolist(), j[found].tolist()):
                while parts and parts[0] < (-k, x, y):
                    c, u, v = heappop(parts)
                    take(-c, u, v)
                take(k, x, y)
            at += seen
            step = min(RUNS, 2 * step) if seen == len(i) else max(FEW, step // 2)
        while parts and stretches:
            c, u, v = heappop(parts)
            take(-c, u, v)
        return stretches
