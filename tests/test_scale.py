"""Large inputs: bounded batches, kernels that work on many pages at once, sums that show as their SQL does."""

import difflib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkledger.functions import degrade, matching, numeric, pieces, raster, text
from inkledger.operators import correction, lines


def test_composite_cost_shows_as_one_sum(spark):
    """A half of the last shown digit falls as it does for tokens times mean rates."""
    rows = spark.createDataFrame([(n, n, "claude+gemini") for n in (148, 316, 372, 540)], "i long, o long, p string")
    got = [r.c for r in rows.select("i", numeric.cost(F.col("i"), F.col("o"), F.col("p")).alias("c")).orderBy("i").collect()]
    assert [f"{c:.6f}" for c in got] == [f"{(n * 1.575 + n * 7.8) / 1e6:.6f}" for n in (148, 316, 372, 540)]


def test_pages_of_one_shape_are_turned_together():
    rng = np.random.default_rng(2)
    images = [raster.page(bytes(rng.integers(0, 256, n, dtype=np.uint8)), 16) for n in (0, 5, 16, 300, 300, 310, 20_000, 300)]
    assert raster.skews(images, most=1000) == [raster.skew(x) for x in images]


def test_lines_page_by_page(spark):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "aaaa"), (-4, "a\n\n\n\n\n\n" * 30)], "k long, t string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("k"), F.col("text").alias("t")).unionAll(odd)
    for width, gap, least, pad in ((2, 2, 3, 1), (4, 1, 2, 2)):
        want = lines.boxes(lines.marks(lines.rows_of(docs, "k", "t", width), "k"), "k", gap, least, pad).collect()
        assert want and sorted(lines.of_pages(docs, "k", "t", width, gap, least, pad).collect()) == sorted(want)


def test_enhanced_pages_in_pieces(spark):
    docs = spark.createDataFrame([(k, "some text " * (k % 40)) for k in range(50)] + [(90, None)], "k long, t string")
    got = {(r.k, r.how): bytes(r.pixels) for r in raster.all_enhanced(docs, "k", "t", 64, most=3000).collect()}
    assert len(got) == 51 * len(raster.ENHANCED)
    for (k, how), pixels in got.items():
        p = raster.page(("some text " * (k % 40) if k < 90 else "").encode(), 64)
        assert pixels == (raster.ENHANCED[how](p).tobytes() if p.size else b""), (k, how)


def test_pieces_are_bounded(spark):
    assert list(pieces.cuts([5, 5, 1, 20, 1], 10, 9)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(pieces.cuts([0] * 5, 10, 2)) == [(0, 2), (2, 4), (4, 5)] and not list(pieces.cuts([]))
    seen = pieces.in_pieces(lambda: lambda s: pd.Series([len(s)] * len(s)), "int")
    counts = [r.n for r in spark.range(5000).repartition(1).select(seen(F.col("id").cast("string")).alias("n")).collect()]
    assert len(counts) == 5000 and max(counts) <= pieces.ROWS


def test_distance_within_a_band():
    r = random.Random(3)
    for n in (0, 3, 40, 700):
        for _ in range(8):
            a = [r.randrange(3) for _ in range(n)]
            b = [x if r.random() < 0.8 else r.randrange(3) for x in a[r.randrange(n // 3 + 1) :]] + [0] * r.randrange(n // 4 + 1)
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            assert text.distance(a, b) == text.distance(b, a) == row[-1]


def test_change_ratio_is_worked_out_once(spark):
    rows = spark.createDataFrame([("abcd", "abxd"), ("q", "zzz"), ("", "")], "a string, b string")
    out = rows.select(text.change_ratio(F.col("a"), F.col("b"), once=True).alias("ratio")).where("ratio <= 0.25")
    assert sorted(r.ratio for r in out.collect()) == [0.0, 0.25]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_matching_has_the_blocks_of_the_library():
    r = random.Random(1)
    for _ in range(300):
        k, n = r.choice((2, 4, 30, 200)), r.choice((5, 40, 400))
        a = [r.randrange(k) for _ in range(r.randrange(n))]
        b = [x if r.random() < 0.9 else r.randrange(k) for x in a if r.random() < 0.95]
        assert matching.SequenceMatcher(a, b).get_opcodes() == difflib.SequenceMatcher(None, a, b).get_opcodes()


def test_distances_share_a_worker(spark):
    """Each Python stage of a plan keeps a worker of its own in every task; an evaluation's distances run in one."""
    pairs = spark.createDataFrame([(1, "the rnembrane", "the membrane"), (2, None, "x"), (3, "", ""), (4, "abc", None)], "key int, corrupted string, clean string")
    out = correction.evaluate(pairs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 2
    assert out.head()["n"] == 4


def test_columns_of_arrow_slices(spark):
    rows = [(k, None if k % 7 == 0 else "é" * (k % 5) + " a b", None if k % 11 == 0 else ["a", "b"] * (k % 3)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "k int, t string, w array<string>").repartition(2, "k")
    pair = pieces.in_pieces(lambda: lambda t, w: pd.DataFrame({"n": [None if x is None else len(x) for x in t], "w": [None if x is None else list(x) for x in w]}), "n int, w array<string>", 2)
    assert {(r.k, r.p.n, None if r.p.w is None else tuple(r.p.w)) for r in frame.select("k", pair("t", "w").alias("p")).collect()} == {(k, None if t is None else len(t), None if w is None else tuple(w)) for k, t, w in rows}
    assert frame.where("k < 0").select(text.edits_between(F.col("t"), F.col("t"))).count() == 0


def test_box_means_of_several_fields_at_once():
    """Fields are filtered together, with the sums of one at a time."""
    rng = np.random.default_rng(4)
    for h, w, reach in ((1, 1, 1), (3, 64, 2), (50, 7, 8)):
        fields = rng.uniform(-1, 1, (2, h, w))
        got = degrade.box(fields, reach)
        for field, own in zip(fields, got):
            x = field
            for axis in (0, 1):
                sums = np.cumsum(np.pad(x, [(reach + 1, reach) if k == axis else (0, 0) for k in (0, 1)], "edge"), axis)
                n, k = sums.shape[axis], 2 * reach + 1
                x = (np.take(sums, np.arange(k, n), axis) - np.take(sums, np.arange(n - k), axis)) / k
            assert np.array_equal(own, x)
