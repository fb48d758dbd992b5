"""Each training-data operator against a plain version, with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.llm import common, components, fingerprint, jaccard_join, mixing, pieces, queries, rans, sharding, suffix_dedup, suffix_tree, topk, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ver string, size string, rank_ string, keep_ int"


def special():
    passage = " ".join(f"word{i}" for i in range(70))
    texts = [None, "", "   \n\t ", "one", "two words", "a " * 400, "ab" * 3000, passage, f"Before {passage} after it", f"{passage} tail", "é世" * 80, "x" * 250_000]
    texts += [passage.upper(), "YOU 1D10T, you are such a l0ser and ѕtupid", "put it in the trash can", "end  of   spaces  ", " lead", "tab\tline\n\nfeed\r\n", "<|endoftext|> it's 12.5€"]
    return [(5000 + i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "clash", "clash", "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "clash", "clash", "clash", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = base + special()
    rows += [rows[3], rows[-12]]  # repeated rows
    rows += [(None, base[0][1], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(rows):
    return sorted(set(r for r in rows if r[0] is not None), key=lambda r: (r[0], zlib.crc32(r[1].encode())))


def checked(frame, want, rows, columns):
    """Every row of the input has its row in the result, with the wanted values."""
    got = Counter((r.doc_id, *(r[c] for c in columns)) for r in frame.collect())
    assert got == Counter((d, *want[d, t]) for d, t in rows)


def test_op1_ids_and_starts(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries._vocabulary("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rans.write_tokens(docs, str(tmp_path / "t"), path, block_ids=3000)
    got = sorted(tuple(r) for r in rans.read_tokens(spark, str(tmp_path / "t"), True).select("start", F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_crc32", "ids").collect())
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], zlib.crc32(r[1].encode()))):
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        want.append((start, -1 if d is None else d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    rans.write_tokens(empty, str(tmp_path / "e"), path)
    assert rans.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_op1_block_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 1), (70, 3), (5000, 2), (200_000, 40_000)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1)
        counts = np.bincount(ids, minlength=kinds)
        freq = rans.scaled(counts)
        assert n == 0 or freq.sum() == 1 << rans.BITS and (freq[counts > 0] > 0).all()
        block = rans.pack_block(np.array([7]), np.array([False]), np.array([n]), ids, freq, every=30_000)
        decoder = rans.Decoder(freq)
        assert (rans.unpack_block(block, decoder)[3] == ids).all()
        parts = rans.Block(block)
        assert parts.stretches == max(1, -(-n // parts.step))
        for k in reversed(range(parts.stretches)):  # each checkpoint alone
            assert (parts.stretch(k, decoder) == ids[k * parts.step : (k + 1) * parts.step]).all()
        if n > 100:
            bad = bytearray(block)
            bad[-9] ^= 4
            with pytest.raises(ValueError):
                rans.unpack_block(bytes(bad), rans.Decoder(freq))


def removed_bytes(rows, width=100):
    seen, want = set(), {}
    for d, t in in_order(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for d, t in rows:
        if d is None:
            want[d, t] = (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest())
    return want


def test_op2_bytes(docs, rows, empty):
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    checked(suffix_dedup.dedup(docs, batch=5000), removed_bytes(rows), rows, columns)
    assert suffix_dedup.dedup(empty).count() == 0
    texts = suffix_dedup.dedup_texts(docs)
    assert texts.columns == docs.columns and texts.count() == docs.count()
    assert texts.where("text is null").count() == docs.where("text is null").count()


def jaccard(rows, q, num, den):
    sets = {}
    for r in set(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        sets[r] = {tuple(w[i : i + q]) for i in range(len(w) - q + 1)} if len(w) >= q else ({tuple(w)} if w else set())
    copies, keys = Counter(rows), list(sets)
    group, links = {k: k for k in keys}, Counter()

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    lists = defaultdict(list)
    for k in keys:
        shared = Counter(y for s in sets[k] for y in lists[s])
        for s in sets[k]:
            lists[s].append(k)
        if sets[k]:
            links[k] += copies[k] - 1
        for y, n in shared.items():
            if den * n >= num * (len(sets[k]) + len(sets[y]) - n):
                links[k] += copies[y]
                links[y] += copies[k]
                group[top(k)] = top(y)
    least = {}
    for k in keys:
        least[top(k)] = min((x for x in (least.get(top(k)), k[0]) if x is not None), default=None)
    return {k: (len(sets[k]), least[top(k)] if sets[k] else k[0], links[k]) for k in keys}


@pytest.mark.parametrize("q,num,den,block", [(4, 85, 100, 4096), (2, 50, 100, 3)])
def test_op3_groups(docs, rows, q, num, den, block):
    checked(jaccard_join.jaccard_groups(docs, q, num, den, block), jaccard(rows, q, num, den), rows, ("n_shingles", "component_id", "n_links"))
    checked(jaccard_join.jaccard_groups(docs, q, num, den, block, 60), jaccard(rows, q, num, den), rows, ("n_shingles", "component_id", "n_links"))  # blocks by shingles


def test_op3_empty_and_keep_one(docs, rows, empty):
    assert jaccard_join.jaccard_groups(empty).count() == 0
    want = jaccard(rows, 5, 80, 100)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    stays = Counter()
    for r, n in Counter(rows).items():
        if not want[r][0]:
            stays[r] = n
        elif r[0] is not None and want[r][1] == r[0]:
            stays[r] = 1
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == stays


def test_op3_signatures_meet():
    rng = np.random.default_rng(5)
    rare = rng.integers(0, 9, 1 << jaccard_join.COUNTER_BITS).astype(np.uint8)
    for num, den in ((85, 100), (80, 100)):
        tops = jaccard_join.levels(num, den)
        for n in (1, 2, 5, 6, 7, 8, 12, 13, 30, 100, 700):
            for _ in range(15):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                lost = rng.integers(0, n * (den - num) // den + 1)
                gained = rng.integers(0, n * (den - num) // den + 1)
                b = np.unique(np.r_[a[lost:], rng.integers(0, 1 << 63, gained, dtype=np.uint64)])
                a = np.unique(a)
                if (n - lost) * den < num * (len(a) + len(b) - (n - lost)):
                    continue
                row, value = np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b]
                r, s, _ = jaccard_join.signatures(row, value, np.array([len(a), len(b)]), rare, num, den, tops)
                assert set(s[r == 0]) & set(s[r == 1]), (n, lost, gained)


def test_op3_rarity_counts_every_document(spark):
    rows = [(k, f"common words in all of them and w{k} alone") for k in range(300)] + [(1000 + k, "one text in many copies") for k in range(50)]
    docs = jaccard_join.c.docs_with_version(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    rare = jaccard_join.rarity(docs, 4)
    text = [t.encode() for _, t in rows[:300]]
    _, value = jaccard_join.shingle_sets(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]), 4)
    seen = np.bincount(jaccard_join.counted(value), minlength=len(rare))
    assert (rare >= np.floor(4 * np.log2(1 + seen)).astype(np.uint8)).all()
    assert rare.max() == np.floor(4 * np.log2(301)) and rare.any()


def test_components(spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1 << 60, 60).tolist()
    edges = [(ids[int(a)], ids[int(b)]) for a, b in rng.integers(0, 60, (30, 2))] + [(ids[i], ids[i + 1]) for i in range(12)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {x: x for x in ids}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    root = {r.node: r.root for r in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(root)
    assert len({(root[x], label[x]) for x in root}) == len({root[x] for x in root}) == len({label[x] for x in root})


def test_op4_threshold_algorithm(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    vectors += [(400, vectors[50][1]), (401, vectors[50][1]), (450, [0.0] * 8), (500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (None, [1.0] * 8), (700, [0.5])]
    vectors += [vectors[100]]
    frame = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    fine = [(i, np.r_[np.floor(256 * np.array(v)), np.zeros(8 - len(v))]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for own, (q, x) in enumerate(fine):  # rows that share an id answer, and are found, each on their own
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for k, (i, v) in enumerate(fine) if k != own)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for cell, many in ((8192, 2048), (40, 3)):
        got = topk.top_k(frame, F.col("vec_id") % 50 == 0, cell=cell, queries=many)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    few = topk.top_k(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e6, 3e9, 1e17])
def test_op4_exact_whatever_the_size(size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)) * size
    x[250:] = x[200:250]  # ties
    v = topk.whole(x.ravel()).reshape(x.shape)
    lists = topk.SortedLists(np.arange(300), np.arange(300), v)
    query, at, score = lists.top(np.arange(0, 300, 7), v[::7], 5)
    plain = [[int(y) for y in row] for row in np.floor(256 * x).tolist()]
    want = []
    for q in range(0, 300, 7):
        best = sorted((-sum(a * b for a, b in zip(plain[q], plain[i])), i) for i in range(300) if i != q)[:5]
        want += [(q // 7, i, -s) for s, i in best]
    assert sorted(zip(query.tolist(), at.tolist(), map(int, score.tolist()))) == sorted(want)


def test_op4_stops_early_where_few_directions_decide():
    rng = np.random.default_rng(5)
    v = topk.whole((rng.normal(size=(20_000, 32)) * np.r_[30, 9, np.full(30, 0.05)]).ravel()).reshape(-1, 32)
    lists = topk.SortedLists(np.arange(len(v)), np.arange(len(v)), v)
    query, at, score = lists.top(np.arange(64), v[:64], 5)
    assert lists.read < 0.6 * lists.pairs
    plain = v[:64] @ v.T
    plain[np.arange(64), np.arange(64)] = np.iinfo(np.int64).min
    assert (np.sort(plain, axis=1)[:, -5:][:, ::-1].ravel() == score[np.argsort(query, kind="stable")]).all()


def test_op5_folding_and_exceptions():
    match = toxicity.Matcher({toxicity.fold(t): 1.0 for t in toxicity.TERMS})
    for bad in ("you idiot", "1D10T!", "ѕtυpid", "lóser.", "L0SER", "ｍｏｒｏｎ", "id​iot"):
        assert match.density(bad) > 0, bad
    for good in ("", "a trash can here", "idiots' is idiotsx", "clownery", "an idiot proof lock", "scumble"):
        assert match.density(good) == 0 or "idiots'" in good, good


def test_op5_held_out(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit(texts, labels)
    assert toxicity.fit(texts.repartition(3), labels.repartition(5)) == model
    got = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.toxic is not None and got[r.doc_id].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    hit = sum(p == t == 1 for p, t in held)
    assert hit >= 0.9 * sum(t for _, t in held) > 0 and hit >= 0.9 * sum(p for p, _ in held)
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    stays = toxicity.accepted(docs, model)
    assert stays.columns == docs.columns and stays.where("doc_id = 5013").count() == 0 and stays.where("doc_id = 5014").count() == 1


def test_op6_words(docs, rows, empty):
    first, want = {}, {}
    for d, t in in_order(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) < d:
                gone[i : i + 50] = [True] * 50
        want[d, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    for d, t in rows:
        if d is None:
            want[d, t] = (len(t.split()), 0, hashlib.sha256(b" ".join(t.encode().split())).hexdigest())
    checked(suffix_tree.dedup(docs, group=100), want, rows, ("n_words", "n_removed", "kept_sha256"))
    assert suffix_tree.dedup(empty).count() == 0


def toxicity_by_hand(model, text):
    """Every term tried at every place of the folded text."""
    folded, words = toxicity.fold(text), max(1, len(text.split()))

    def at(term, i):
        return folded.startswith(term, i) and not (i and folded[i - 1].isalnum())

    def whole(term, i):
        return at(term, i) and not folded[i + len(term) : i + len(term) + 1].isalnum()

    phrases = [toxicity.fold(x) for x in toxicity.EXCEPTIONS]
    harmless = [(i, i + len(x)) for x in phrases for i in range(len(folded)) if whole(x, i)]
    total, stems, heavy = 0.0, 0, 0.0
    for i in range(len(folded)):
        found = [(w, i + len(t), True) for t, w in model.weights.items() if whole(t, i)] + [(w, i + len(t), False) for t, w in model.stems.items() if at(t, i)]
        if found:
            most = max(w for w, _, _ in found)
            end, term = [(e, k) for w, e, k in found if w == most][0]
            if any(x <= i and end <= y for x, y in harmless):
                continue
            total += most if term else 0.0
            stems, heavy = stems + (not term), heavy + (0.0 if term else most)
    allowed = toxicity.RATE * words
    if stems > allowed:
        total += heavy / stems * (stems - allowed)
    low, density = 0.1 * stems / (stems + allowed), total / words**0.5
    return low + (1 - low) * density / (density + model.scale) if density > 0 else low


def test_op5_scores_equal_a_plain_matcher():
    weights = {toxicity.fold(t): 1.0 + i / 100 for i, t in enumerate(toxicity.TERMS)}
    model = toxicity.Model(weights, {"idio": 0.5, "schei": 2.0, "mero": 3.0}, 0.4)
    match, draw = model.matcher(), random.Random(5)
    pool = ["trash", "can", "trash can", "x", "moron", "1d10t", "not", "stupid", "not stupid", "idiotic", "scheisse", "mero", "not an idiot", "ѕcum", "pond scum", "shut", "up", "kill yourself", "a!b", "sore loser,", "losers."]
    texts = ["", "  ", "trash can", "trash cans", "not an idiot proof"] + [" ".join(draw.choices(pool, k=draw.randint(1, 60))) for _ in range(150)]
    for text in texts:
        assert model.score(*match.measure(text)) == pytest.approx(toxicity_by_hand(model, text), abs=1e-12)


def test_op5_many_exceptions_take_linear_time():
    match = toxicity.Matcher({toxicity.fold(t): 1.0 for t in toxicity.TERMS})
    began = time.perf_counter()
    assert match.density("trash can x moron " * 100_000) == pytest.approx(100_000 / 400_000**0.5)
    assert time.perf_counter() - began < 30  # comparing each hit with each phrase takes hours


def test_op7_targets_and_quotas(docs, empty):
    got = mixing.taken(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(3)).collect()), key=str)
    size, taken, goal, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        goal[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * size[s]}
        for s in over or open_:
            want[s] = 2.0 * size[s] if over else unit * weight[s]
            left -= want[s]
        open_ -= over or open_
    for s in size:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert mixing.taken(empty).count() == 0


def test_op7_tree_deals_every_ticket_once(docs):
    _, blocks = mixing.plan(docs)
    tickets = mixing.split(blocks, 2).collect()
    assert len({(r.source, r.block, r.draw) for r in tickets}) == len(tickets)
    shares = Counter(r["shard"] for r in tickets)
    assert len(shares) == 4 and max(shares.values()) - min(shares.values()) <= 2
    plain = docs.where("doc_id is not null and doc_id <> 5007")
    drawn = Counter(r.doc_id for r in mixing.mixed_documents(plain).collect())
    copies = Counter()
    for r in mixing.taken(plain).collect():
        copies[r.doc_id] += r.taken // r.size if r.size else 0
    assert +copies == drawn
    got = mixing.mix(plain)
    assert got.columns[: len(docs.columns)] == docs.columns


def drawn_by_hand(unit, total, marked, drawn):
    """The hypergeometric distribution inverted in exact numbers, values taken from the mode upwards, then downwards."""
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    ways = {x: math.comb(marked, x) * math.comb(total - marked, drawn - x) for x in range(low, high + 1)}
    mode, left = max(low, min(high, (drawn + 1) * (marked + 1) // (total + 2))), Fraction(unit) * sum(ways.values())
    for x in [*range(mode, high + 1), *range(mode - 1, low - 1, -1)]:
        left -= ways[x]
        if left < 0:
            return x


def test_op7_draws_are_hypergeometric(spark):
    draw = random.Random(3)
    rows = [(u, t, draw.randint(0, t), draw.randint(0, t)) for t in (0, 1, 2, 5, 60, 900, 4000) for u in (1e-12, 0.05, 0.5, 0.9, 1 - 1e-9) for _ in range(6)]
    rows += [(0.3, 10, 10, 4), (0.3, 10, 0, 4), (0.3, 10, 4, 10), (0.3, 10, 4, 0)]
    table = spark.createDataFrame(rows, "u double, t long, k long, d long")
    for r in table.withColumn("x", mixing.hypergeometric(*map(F.col, "utkd"))).collect():
        assert r.x == drawn_by_hand(r.u, r.t, r.k, r.d)


def test_op7_quotas_follow_a_replay_and_only_counts_meet(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 1)
    sizes = {None: 7, "a": 1, "b": 300, "é": 41}
    counts = spark.createDataFrame(list(sizes.items()), "source string, n long")
    got = {(r.shard, r.source): r.n for r in mixing.quotas(counts, 3).collect()}
    nodes = [{s: sizes[s] for s in sorted(sizes, key=lambda s: (s is not None, s or ""))}]
    for level in range(3):
        cells = [(level, i, s) for i, counted in enumerate(nodes) for s in counted]
        asked = spark.createDataFrame(cells, "level int, node int, source string")
        odd = F.pmod(F.xxhash64(F.lit(mixing.SEED + 2), "level", "node"), F.lit(2))
        unit = mixing._unit(F.lit(mixing.SEED + 3), "level", "node", "source")
        units = {(r.node, r.source): (r.unit, r.odd) for r in asked.select("node", "source", unit.alias("unit"), odd.alias("odd")).collect()}
        below = []
        for i, counted in enumerate(nodes):
            rest = sum(counted.values())
            goal, left = (rest + units[i, None][1]) // 2, {}
            for s, n in counted.items():
                left[s] = drawn_by_hand(units[i, s][0], rest, n, goal)
                rest, goal = rest - n, goal - left[s]
            below += [left, {s: n - left[s] for s, n in counted.items()}]
        nodes = below
    assert got == {(i, s): n for i, counted in enumerate(nodes) for s, n in counted.items()}
    _, blocks = mixing.plan(docs)
    tickets = mixing.split(blocks, 4)
    plan = tickets._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("SinglePartition") == 1  # the counts by source
    quota = Counter()
    for r in mixing.quotas(blocks.selectExpr("source", "passes + int(last > 0) as n").groupBy("source").agg(F.sum("n").alias("n")), 4).collect():
        quota[r.source, r.shard] += r.n
    assert Counter((r.source, r.shard) for r in tickets.collect()) == +quota


def best_cut(coder, text):
    """Plain Viterbi over the whole text."""
    score = {int(i): s for i, s in zip(coder.ids, coder.scores)}
    piece = {coder.text[i].decode().replace(" ", "▁"): i for i in score}
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - coder.longest), end):
            i = piece.get(text[start:end])
            s = score[i] if i is not None else coder.unknown if end - start == 1 else -math.inf
            best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_op8_viterbi_and_round_trip(docs, rows, empty):
    path = queries._vocabulary("piece_bpe_32k.model")
    coder = pieces.coder(path)
    score = {int(i): s for i, s in zip(coder.ids, coder.scores)}
    for text in [t for _, t in rows if 0 < len(t) < 1500][:40] + ["Hello  world", "  x ", "日本\n語", "á"]:
        ids = np.frombuffer(coder.encode([text])[0], np.int32).tolist()
        spelled, total = 0, 0.0
        for i in ids:
            if i in score:
                total += score[i]
            else:
                spelled += (coder.text[i][0] & 0xC0) != 0x80  # one for each unknown character
        assert total + spelled * coder.unknown == pytest.approx(best_cut(coder, ("▁" + text).replace(" ", "▁")))
        assert coder.decode(ids) == text.replace("▁", " ")
    got = pieces.encode(docs, path)
    assert Counter((r.doc_id, r.decoded_sha256) for r in got.collect()) == Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.text) for r in pieces.decode(got, path).collect()) == Counter(rows)
    assert pieces.encode(empty, path).count() == 0


def plain_digest(text):
    """Length step and quartiles, byte by byte."""
    b, counts = text.encode(), [0] * 256
    for i in range(len(b) - 3):
        for (x, y, z), salt in (((0, 1, 2), 1), ((0, 1, 3), 3), ((0, 2, 3), 5)):
            h = ((b[i + x] << 16 | b[i + y] << 8 | b[i + z]) + (salt << 24)) * 0x9E3779B1 % 2**32
            counts[(h ^ h >> 15) * 0x85EBCA77 % 2**32 >> 24] += 1
    if 0 < len(b) < 4:
        counts[sum(x * y for x, y in zip(b, (1, 7, 31))) % 256] += 1
    edges = [sorted(counts)[k] for k in (64, 128, 192)]
    return round(math.log2(len(b) + 1) * 8), [sum(n > e for e in edges) for n in counts]


def plain_likeness(a, b):
    steps = sum({3: 4}.get(abs(x - y), abs(x - y)) for x, y in zip(a[1], b[1]))
    return 1 - min(steps + max(0, abs(a[0] - b[0]) / 4 - 1), 256) / 256


def test_op9_digest_by_hand():
    texts = ["", "a", "xyz", "four", "the quick brown fox", "the quick brown fix", "é世" * 40, "word " * 300, "x" * 900, "AbC\0\n" * 7]
    hand = [plain_digest(t) for t in texts]
    digest = fingerprint._of(texts)
    assert [(d[0], d[1:].tolist()) for d in digest] == hand
    for t, (length, quartiles) in zip(fingerprint.texts_of(digest), hand):
        raw = bytes.fromhex(t)
        assert raw[0] == length and [raw[1 + k // 4] >> 2 * (k % 4) & 3 for k in range(256)] == quartiles
        assert fingerprint.parse(t).tolist() == [length, *quartiles]
    for i in range(len(texts)):
        assert fingerprint.likeness(digest, np.roll(digest, i, axis=0)).tolist() == [plain_likeness(x, y) for x, y in zip(hand, hand[-i:] + hand[:-i])]


def test_op9_neighbours_and_likeness(docs, rows, empty):
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    want = Counter()
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        x, y, z = (fingerprint._of([s]) for s in (t, new, after))
        want[d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.texts_of(x)[0], fingerprint.texts_of(y)[0], float(fingerprint.likeness(x, y)[0]), float(fingerprint.likeness(x, z)[0])] += 1
    got = fingerprint.fingerprints(docs, 7).collect()
    assert Counter(tuple(r) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited > r.near_next for r in got if r.n_chars > 300]) > 0.9
    assert fingerprint.fingerprints(empty).count() == 0


def test_op10_bytes_slots_and_groups(spark, docs, rows, empty):
    got = sharding.assign(docs, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows)
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(docs.repartition(2), 8).collect()))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text for a third of all rows").otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    shares = sharding.assign(many).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    mean = sum(r.n for r in shares) / 40
    assert len(shares) == 40 and all(abs(r.n - mean) < 0.02 * mean for r in shares)
    assert sharding.assign(empty).count() == 0


def test_op10_large_groups_are_numbered_in_parts(spark):
    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = sharding.assign(many, 3).collect()
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len(got) == 12_000


def test_op2_levels_hold_suffix_arrays_and_merge():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 4, 5000).astype(np.uint8)
    family, seen, at = suffix_dedup.IndexFamily(20), {}, []
    for batch in range(9):
        n = rng.integers(30, 400, 6)
        begin = rng.integers(0, 4000, 6)
        symbols = np.concatenate([passage[b : b + k] for b, k in zip(begin, n)])
        symbols[::97] = batch
        doc = rng.integers(0, 50, 6)
        pos = batch * 1000 + rng.integers(0, 100, 6) * 7
        cols = {"anchor": n, "doc": doc, "ver": n * 0, "pos": pos, "n": n - 19}
        family.add(suffix_dedup.r.Pieces(cols, symbols, 20))
        ends = np.cumsum(n)
        for k in range(6):
            part = symbols[ends[k] - n[k] : ends[k]].tobytes()
            at += [(part[i : i + 20], (int(doc[k]), 0, int(pos[k]) + i)) for i in range(len(part) - 19)]
        sizes = [size for size, _ in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
        for _, level in family.levels:
            windows = [level.symbols[s : s + 20].tobytes() for s in level.start]
            assert windows == sorted(set(windows))
    for window, place in at:
        seen[window] = min(place, seen.get(window, place))
    want = {place for window, place in at if place != seen[window]}
    assert {tuple(map(int, x)) for x in zip(*family.result())} == want


def test_op6_subtrees_are_bounded_by_the_group():
    rng = np.random.default_rng(7)
    symbols = np.r_[rng.integers(0, 3, 4000), np.zeros(300, np.int64)].astype(np.uint64)
    starts = np.arange(len(symbols) - 11)
    parts = list(suffix_tree.prefix_groups(symbols, starts, 50, 12))
    assert sorted(np.concatenate([m for m, _ in parts]).tolist()) == starts.tolist()
    assert all(len(m) <= 50 or d == 12 for m, d in parts)
    found = {frozenset(x.tolist()) for m, d in parts for x in suffix_tree.deep_nodes(symbols, starts, m, d, 12)}
    plain = defaultdict(set)
    for i in starts.tolist():
        plain[symbols[i : i + 12].tobytes()].add(i)
    assert found == {frozenset(x) for x in plain.values() if len(x) > 1}


def test_op2_and_op6_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.r, "STRIDE", 300)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 900, 1500)]
    text = " ".join(words)
    data = np.frombuffer(text.encode(), np.uint8)
    for scheme, n in ((suffix_dedup.r.Scheme("bytes", 100, 32, False), len(data)), (suffix_dedup.r.Scheme("words", 50, 8, True), len(words))):
        whole = scheme.symbols(data, np.array([0, len(data)]))[0]
        covered = np.zeros(n, int)
        for symbols, cuts, base in scheme.stretches(data, np.array([0, len(data)])):
            part = whole[base : base + len(symbols)]
            assert (symbols == part).all() and cuts.tolist() == [0, len(symbols)]
            covered[base : base + max(0, len(symbols) - scheme.width + 1)] += 1
        assert (covered[: n - scheme.width + 1] == 1).all() and not covered[n - scheme.width + 1 :].any()


def test_packer_round_trip():
    fields = [("a", "<u8"), ("b", "<u2")]
    packer = common.Packer(fields, 4, limit=10)
    a, b = np.arange(35, dtype=np.uint64), np.arange(35) % 7
    out = [x for i in range(0, 35, 7) for x in packer.add(a[i : i + 7], a[i : i + 7], b[i : i + 7])] + list(packer.flush())
    got = list(common.unpacked(iter(out), fields))
    assert sorted(zip(got[0]["a"].tolist(), got[0]["b"].tolist())) == list(zip(a.tolist(), b.tolist()))


def test_word_tokenizer_equals_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = rans.WordTokenizer(path), Tokenizer.from_file(path)
    draw = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "word", "É", "12", "it's", "'s", ".", ",!", "\0", "<|endoftext|>", "\u00a0", "\u3000", "中文", "\x85", "²"]
    texts = ["", " ", "\n", "a ", "a\n", *("".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(3000))]
    want = [np.array(x.ids, "<u2").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


# ---- words of a regular build that sums of powers cannot tell apart ------------------------------------------------------


def thue_morse(size, letters="ab"):
    return "".join(letters[bin(k).count("1") & 1] for k in range(size))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_regular_words_are_told_apart(spark, size):
    from inkledger.llm import jaccard_join, suffix_dedup, suffix_tree

    one, other = thue_morse(size), thue_morse(size, "ba")
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    starts, ends, _ = common.words_of(data, np.array([0, len(data)]))
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 2
    tail = " ".join(f"w{k}" for k in range(60))
    rows = [(1, one), (2, other), (3, f"{one} {tail}"), (4, f"{other} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r.doc_id: r.n_removed for r in suffix_tree.dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 60}
    first, want = {}, {}
    for k, (_, t) in enumerate(rows):
        b, gone = t.encode(), bytearray(len(t))
        for i in range(len(b) - 99):
            if b[i : i + 100] in first:
                gone[i : i + 100] = b"\1" * 100
            first.setdefault(b[i : i + 100], k)
        want[rows[k][0]] = sum(gone)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(docs).collect()} == want
