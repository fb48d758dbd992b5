"""Whole jobs on inputs whose tasks, lists or batches are out of the ordinary."""

import numpy as np
import pyarrow as pa

from inkledger.llm import context_mixing, fingerprint, jaccard_join


def test_op9_range_of_one_row(spark):
    """A task may hold nothing but the next range's first document."""
    assert fingerprint.texts_of(fingerprint._of([])) == []
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs, 64).collect()}
    assert sorted(got) == list(range(6)) and all(r.n_chars == 6 for r in got.values())


def test_op3_shared_passages_make_few_lists():
    """With full counters, as on large inputs, sets that share a passage of 47 of their 350 shingles seldom share a list; all of them did when prefixes were listed."""
    rng = np.random.default_rng(3)
    rare, n, passage = np.full(1 << jaccard_join.COUNTER_BITS, 24, np.uint8), 200, rng.integers(0, 1 << 63, 47, dtype=np.uint64)
    sets = [np.sort(np.r_[passage, rng.integers(0, 1 << 63, 303, dtype=np.uint64)]) for _ in range(n)]
    row, value = np.repeat(np.arange(n), 350), np.concatenate(sets)
    r, s, _ = jaccard_join.signatures(row, value, np.full(n, 350), rare, 85, 100, jaccard_join.levels(85, 100))
    lists = {}
    for k, x in zip(r.tolist(), s.tolist()):
        lists.setdefault(x, set()).add(k)
    pairs = {(a, b) for own in lists.values() for a in own for b in own if a < b}
    assert len(pairs) < 0.1 * n * (n - 1) / 2, len(pairs)


def test_op3_sets_of_common_shingles_meet():
    """Linked sets share a list whether their shingles are common, rare or mixed."""
    rng = np.random.default_rng(4)
    tops = jaccard_join.levels(85, 100)
    for common in range(11):
        rare = np.where(rng.integers(0, 10, 1 << jaccard_join.COUNTER_BITS) < common, 200, 0).astype(np.uint8)
        for n in (7, 8, 13, 20, 60, 350, 900):
            for _ in range(10):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                b = np.unique(np.r_[a[n * 3 // 40 :], rng.integers(0, 1 << 63, n * 3 // 40, dtype=np.uint64)])
                both = len(np.intersect1d(a, b))
                assert 100 * both >= 85 * (len(a) + len(b) - both)
                r, s, _ = jaccard_join.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]), rare, 85, 100, tops, 100)
                assert set(s[r == 0]) & set(s[r == 1]), (common, n)


def test_op3_unrelated_sets_of_any_size_seldom_meet():
    """Sets of sizes at a level's low end too list no empty parts, and a shared passage does not link them into one cluster."""
    rng = np.random.default_rng(6)
    rare = np.full(1 << jaccard_join.COUNTER_BITS, 24, np.uint8)
    tops = jaccard_join.levels(80, 100)
    for size in (230, 265, 350, 560):
        passage, n = rng.integers(0, 1 << 63, size // 8, dtype=np.uint64), 60
        sets = [np.sort(np.r_[passage, rng.integers(0, 1 << 63, size - len(passage), dtype=np.uint64)]) for _ in range(n)]
        r, s, scheme = jaccard_join.signatures(np.repeat(np.arange(n), size), np.concatenate(sets), np.full(n, size), rare, 80, 100, tops)
        assert len(_met(r, s, scheme, 80, 100)) < 0.02 * n * (n - 1) / 2, size


def test_op3_linked_sets_meet_as_often_as_needed():
    """Linked sets stay together when their lists are short and when they are long, for sets with and without common shingles."""
    rng = np.random.default_rng(7)
    for num, den in ((80, 100), (85, 100)):
        tops = jaccard_join.levels(num, den)
        for common in (0, 5, 10):
            rare = np.where(rng.integers(0, 10, 1 << jaccard_join.COUNTER_BITS) < common, 200, 0).astype(np.uint8)
            for n in (7, 20, 90, 230, 280, 700, 2000):
                for copies in (2, 40):
                    lost = n * (den - num) // (2 * den)
                    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                    sets = [np.unique(np.r_[base[lost:], rng.integers(0, 1 << 63, lost // 4, dtype=np.uint64)]) for _ in range(copies)]
                    size = np.array([len(x) for x in sets])
                    r, s, scheme = jaccard_join.signatures(np.repeat(np.arange(copies), size), np.concatenate(sets), size, rare, num, den, tops, 100)
                    met = _met(r, s, scheme, num, den)
                    assert len({x for pair in met for x in pair}) == copies and all((0, k) in met or (k, 0) in met for k in range(1, copies)), (num, common, n, copies)


def _met(row, sig, scheme, num, den):
    """Pairs of rows that meet in as many lists as they need, or that a long list's leader joins (here as pairs with row 0)."""
    payload = b"".join(x.tobytes() for x in (sig, row.astype(np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])
    total, need = {}, {}
    for b in jaccard_join._meetings(num, den)(iter([batch])):
        for x, y, k, least in zip(*(b.column(i).to_pylist() for i in range(4))):
            total[x, y] = total.get((x, y), 0) + k
            need[x, y] = min(least, need.get((x, y), least))
    return {pair for pair in total if total[pair] >= need[pair]}


def test_op13_every_training_decision_teaches(monkeypatch):
    """Large mixers too learn from all of their decisions, at least once."""
    monkeypatch.setattr(context_mixing, "TEACH", 10)
    shared = context_mixing.Shared(np.array([1 << 40 | 97 << 16 | 97 << 8 | 98, 1 << 40 | 98 << 16 | 98 << 8 | 97]), np.array([5.0, 3.0]))
    grams = np.array([int.from_bytes(b"ababa", "little") | s << 40 for s in range(256)])
    mixer = context_mixing.Mixer(shared, grams, grams >> 40 & 1)
    seen, plain = [], mixer.inputs
    mixer.inputs = lambda pick, out: (seen.append(pick), plain(pick, out))[1]
    mixer.teach()
    assert sorted(np.concatenate(seen).tolist()) == np.flatnonzero(mixer.weight > 0).tolist()
