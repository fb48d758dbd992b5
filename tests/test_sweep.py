"""Sweeps, comparisons, degradations and anomalies with reasons, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from inkledger.functions import degrade, raster
from inkledger.plans import reports, sweep
from pyspark.sql import functions as F

OUTPUTS = "sample_id long, provider string, strategy string, error_rate double"


def outputs(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        for provider in ("claude", "gemini", "openai"):
            rows.append((k, provider, "single", None if r.random() < 0.1 else round(r.random() * {"claude": 1, "gemini": 0.5, "openai": 0.9}[provider], 2)))
        rows.append((k, "claude+gemini", "vote", round(r.random() * 0.4, 2)))
        if k % 2:
            rows.append((k, "claude+gemini", "cascade", round(r.random() * 0.4, 2)))
    return [*rows, (999, "claude", "single", math.inf), (998, "other", "single", 0.1)]


def plain_pairs(rows):
    own = {}
    for sample, provider, strategy, error in rows:
        name = provider if strategy == "single" else strategy
        if error is not None and math.isfinite(error) and name in sweep.CONFIGURATIONS:
            own.setdefault(name, {})[sample] = error
    out = {}
    for a, b in sweep.pairs_of():
        out[a, b] = [round(own[b][k] - own[a][k], 9) for k in own.get(a, {}) if k in own.get(b, {})]
    return out


def plain_test(d):
    moved = [x for x in d if x]
    order = sorted(abs(x) for x in moved)
    rank = {v: np.mean([i + 1 for i, x in enumerate(order) if x == v]) for v in set(order)}
    plus, minus = sum(rank[abs(x)] for x in moved if x > 0), sum(rank[abs(x)] for x in moved if x < 0)
    m, ties = len(moved), sum(t**3 - t for t in Counter(order).values())
    w = min(plus, minus)
    if m < 6:
        return w, None
    z = (w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    return w, min(1.0, 2 * 0.5 * math.erfc(abs(z) / math.sqrt(2)))


def test_sweep_equals_plain_tests(spark):
    rows = outputs()
    got = {(r.a, r.b): r for r in sweep.run_sweep(spark.createDataFrame(rows, OUTPUTS).repartition(4), rounds=2000).collect()}
    want = {k: d for k, d in plain_pairs(rows).items() if d}
    assert set(got) == set(want) and len(want) == 10
    for k, d in want.items():
        w, p = plain_test(d)
        assert got[k].n == len(d) and got[k].mean == pytest.approx(np.mean(d), abs=1e-9) and got[k].w == pytest.approx(w) and got[k].p == pytest.approx(p, abs=2e-6)
        assert got[k].low <= got[k].mean <= got[k].high
        half = 1.96 * np.std(d) / math.sqrt(len(d))
        assert got[k].high - got[k].low == pytest.approx(2 * half, rel=0.15)


def test_sweep_repeats_and_knows_few_pairs(spark):
    few = [(k, p, "single", 0.1 * k + (p == "gemini") * 0.05 * (k + 1)) for k in range(4) for p in ("claude", "gemini")]
    df = spark.createDataFrame(few, OUTPUTS)
    one, two = sweep.run_sweep(df, rounds=300).collect(), sweep.run_sweep(df.repartition(3), rounds=300).collect()
    assert one == two and one[0].p is None and one[0].w == 0.0
    same = sweep.run_sweep(spark.createDataFrame([(k, p, "single", 0.2) for k in range(9) for p in ("claude", "openai")], OUTPUTS), rounds=50).head()
    assert (same.mean, same.w, same.p, same.low, same.high) == (0.0, 0.0, None, 0.0, 0.0)
    assert sweep.run_sweep(spark.createDataFrame([], OUTPUTS)).count() == 0


def test_standings_and_compare_report(spark):
    rows = outputs()
    ranks = [r.configuration for r in sweep.standings(spark.createDataFrame(rows, OUTPUTS)).orderBy("rank").collect()]
    assert set(ranks) == set(sweep.CONFIGURATIONS) and ranks[-1] in ("claude", "openai")
    before = spark.createDataFrame([(k, "claude", "single", 0.5) for k in range(8)] + [(1, "old", "vote", 0.1)], OUTPUTS)
    after = spark.createDataFrame([(k, "claude", "single", 0.5 - 0.01 * (k + 1)) for k in range(8)] + [(2, "new", "vote", 0.1)], OUTPUTS)
    lines = [r.text for r in sweep.compare_report(before, after).collect()]
    assert lines[0].split() == ["provider/strategy", "before", "after", "change"] and set(lines[1]) == {"-"}
    assert lines[2].split() == ["claude/single", "50.00%", "45.50%", "-4.50%", "better"]
    assert lines[3].split() == ["new/vote", "-", "10.00%", "new"] and lines[4].split() == ["old/vote", "10.00%", "-", "removed"]
    assert lines[5].startswith("paired samples: 8, mean change -0.")


# ---- degradations -----------------------------------------------------------------------------------------------------------


def sheet(h=40, w=50):
    image = np.full((h, w), 250, np.uint8)
    image[10:14, 5:45] = 20
    image[20:35, 12:15] = 30
    return image


@pytest.mark.parametrize("kind", sorted(degrade.KINDS))
def test_degradations_repeat_and_keep_the_size(kind):
    image = sheet()
    got = degrade.degraded(image, "k", kind, degrade.STRENGTHS[kind])
    assert got.shape == image.shape and got.dtype == np.uint8 and (got != image).any()
    assert (got == degrade.degraded(image, "k", kind, degrade.STRENGTHS[kind])).all()
    if kind in ("noise", "perspective", "elastic"):
        assert (got != degrade.degraded(image, "other", kind, degrade.STRENGTHS[kind])).any()
    if kind in ("low_contrast", "perspective", "elastic", "noise", "crop"):
        assert (degrade.degraded(image, "k", kind, 0.0) == image).all()
    assert degrade.degraded(np.zeros((0, 9), np.uint8), "k", kind, 0.5).shape == (0, 9)
    assert degrade.degraded(np.full((1, 3), 7, np.uint8), "k", kind, 0.1).shape == (1, 3)


def test_sampling_equals_plain_interpolation():
    image, r = sheet(12, 9), np.random.default_rng(0)
    rows, cols = r.uniform(-3, 14, (5, 7)), r.uniform(-3, 12, (5, 7))

    def at(y, x):
        return float(image[y, x]) if 0 <= y < 12 and 0 <= x < 9 else 255.0

    for y, x, v in zip(rows.ravel(), cols.ravel(), degrade.sampled(image, rows, cols).ravel()):
        y, x = min(max(y, -1), 12), min(max(x, -1), 9)
        a, b = math.floor(y), math.floor(x)
        want = (at(a, b) * (1 - (x - b)) + at(a, b + 1) * (x - b)) * (1 - (y - a)) + (at(a + 1, b) * (1 - (x - b)) + at(a + 1, b + 1) * (x - b)) * (y - a)
        assert abs(int(v) - want) <= 0.5 + 1e-6


def test_corners_go_where_they_should():
    source = np.array([(0, 0), (9, 0), (9, 19), (0, 19)], float)
    target = source + np.array([(1, 2), (-1.5, 0.5), (-2, -1), (0.5, -3)])
    m = degrade.homography(source, target)
    for (x, y), want in zip(source, target):
        u, v, z = m @ [x, y, 1]
        assert (u / z, v / z) == pytest.approx(tuple(want))


def test_box_means_equal_plain_windows():
    x = np.random.default_rng(2).random((9, 11))
    wide = np.pad(x, 2, "edge")
    want = [[wide[i : i + 5, j : j + 5].mean() for j in range(11)] for i in range(9)]
    assert degrade.box(x, 2) == pytest.approx(np.array(want))


def test_variants_are_rows(spark):
    docs = spark.createDataFrame([(1, "some text of a page " * 30), (2, None)], "k int, t string")
    rows = degrade.variants(docs, "k", "t", 32).collect()
    assert len(rows) == 2 * len(degrade.KINDS)
    page = raster.page(("some text of a page " * 30).encode(), 32)
    for r in rows:
        want = degrade.degraded(page, "1", r.kind, r.strength).tobytes() if r.k == 1 else b""
        assert bytes(r.pixels) == want
    with pytest.raises(ValueError, match="Unknown degradation"):
        degrade.variants(docs, "k", "t", 32, {"smoke": 1.0})


# ---- anomalies ----------------------------------------------------------------------------------------------------------------


def test_anomalies_with_reasons(spark):
    long = "the same long answer about cells and their many parts in the body"
    rows = [(1, "Ann", long), (2, "Bob", long), (3, "Cem", "quite another text with nothing in common at all"), (4, "Dee", "typed pages look different from this one here")]
    subs = spark.createDataFrame(rows, "k int, name string, t string")
    typed = spark.createDataFrame([(4, True, 0.65), (3, False, 0.2), (2, True, 0.8)], "k int, is_typed boolean, confidence double")
    got = {r.k: (r.name, list(r.reasons), [(p.other, p.other_name, p.score) for p in r.similar]) for r in reports.anomalies_with_reasons(subs, "k", "name", "t", typed).collect()}
    assert got == {
        1: ("Ann", ["High text similarity (100%) with Bob"], [(2, "Bob", 1.0)]),
        2: ("Bob", ["High text similarity (100%) with Ann", "Possible typed/printed text (confidence: 80%)"], [(1, "Ann", 1.0)]),
        4: ("Dee", ["Possible typed/printed text (confidence: 65%)"], []),
    }
    assert reports.anomalies_with_reasons(subs.limit(0), "k", "name", "t", typed.limit(0)).count() == 0


def test_miscalibrated_rows(spark):
    rows = [(1, k, c, e) for k, (c, e) in enumerate([(0.9, 0.2), (0.7, 0.5), (0.71, 0.1), (0.8, 0.11), (0.95, None)])] + [(2, k, 0.9, 0.9) for k in range(7)]
    df = spark.createDataFrame(rows, "run int, id int, confidence double, error_rate double")
    got = sorted((r.run, r.place, r.id, r.found) for r in reports.miscalibrated(df, ["run"], ["id"]).collect())
    assert got == [(1, 1, 0, 2), (1, 2, 3, 2), *((2, k + 1, k, 7) for k in range(5))]


def test_grey_levels_of_a_page_sum_up(spark):
    df = spark.createDataFrame([(1, "abc")], "k int, t string").select(F.length("t").alias("n"))
    assert df.head().n == raster.page(b"abc", 3).size
