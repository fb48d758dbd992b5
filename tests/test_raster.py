"""Page kernels against plain loops over small images."""

import math

import numpy as np
import pytest
from inkledger.functions import misreading, raster
from inkledger.operators import lines


def ruled(h=120, w=160, every=12, thick=4):
    image = np.full((h, w), 255, np.uint8)
    for y in range(6, h - thick, every):
        image[y : y + thick, 10 : w - 10] = 0
    return image


# ---- skew ------------------------------------------------------------------------------------------------------------


def plain_skew(image):
    h, w = image.shape
    bound = image.mean() * 0.75
    best, angle = 0.0, 0.0
    for k in range(-20, 21):
        turn = -math.radians(k * 0.25)
        profile = []
        for y in range(h):
            n = 0
            for x in range(w):
                u, v = x + 0.5 - w / 2, y + 0.5 - h / 2
                col, row = math.floor(math.cos(turn) * u + math.sin(turn) * v + w / 2), math.floor(-math.sin(turn) * u + math.cos(turn) * v + h / 2)
                n += 0 <= col < w and 0 <= row < h and image[row, col] < bound
            profile.append(n)
        mean = sum(profile) / h
        variance = sum((n - mean) ** 2 for n in profile) / h
        if variance > best + 1e-9:
            best, angle = variance, k * 0.25
    return angle if abs(angle) >= 1.0 else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_skew_equals_plain_loops(seed):
    image = np.random.default_rng(seed).integers(0, 256, (31, 45)).astype(np.uint8)
    assert raster.skew(image) == plain_skew(image)


@pytest.mark.parametrize("angle", [-4.0, -2.0, 2.5, 4.5])
def test_a_known_angle_is_found(angle):
    tilted = raster.turn(ruled(200, 260), angle)
    assert raster.skew(tilted) == pytest.approx(-angle, abs=0.5)
    assert raster.skew(raster.deskewed(tilted)) == 0.0


def test_straight_blank_and_empty_pages_have_no_skew():
    assert raster.skew(ruled()) == 0.0
    assert raster.skew(np.full((40, 40), 255, np.uint8)) == 0.0
    assert raster.skew(np.zeros((0, 64), np.uint8)) == 0.0


def test_large_pages_are_reduced():
    image = ruled(1300, 700, 60, 20)
    small = raster.reduced(image)
    assert max(small.shape) == 600 and abs(small.mean() - image.mean()) < 2
    assert raster.reduced(small) is small


# ---- style and typed text ----------------------------------------------------------------------------------------------


def plain_style(image):
    bound, runs = image.mean() * 0.75, []
    for row in image:
        n = 0
        for v in [*row, 255]:
            if v < bound:
                n += 1
            elif n:
                runs.append(n)
                n = 0
    if not runs:
        return "mixed"
    share = sum(r > 2 * sum(runs) / len(runs) for r in runs) / len(runs)
    return "cursive" if share > 0.25 else "print" if share < 0.10 else "mixed"


@pytest.mark.parametrize("seed", range(4))
def test_style_equals_plain_runs(seed):
    r = np.random.default_rng(seed)
    image = np.where(np.repeat(r.random((20, 30)) < 0.4, r.integers(1, 6), axis=1), 0, 255).astype(np.uint8)
    assert raster.style(image) == plain_style(image)


def test_styles_by_their_runs():
    def page(*runs):
        row = [255]
        for n in runs:
            row += [0] * n + [255] * 2 * n
        return np.tile(np.array(row, np.uint8), (5, 1))

    assert raster.style(page(2, 2, 2, 2)) == "print" and raster.style(page(1, 1, 9, 1, 9, 1)) == "cursive" and raster.style(page(1, 1, 9, 1, 1, 1)) == "mixed"
    assert raster.style(np.full((9, 9), 255, np.uint8)) == "mixed" and raster.style(np.zeros((0, 9), np.uint8)) == "mixed"


def test_typed_text():
    small = raster.typed(np.zeros((49, 80), np.uint8))
    assert small == {"is_typed": False, "confidence": 0.0, "indicators": ["Image too small for analysis"]}
    stripes = np.full((100, 100), 255, np.uint8)
    stripes[:, ::4] = 0
    got = raster.typed(stripes)
    assert got["is_typed"] and got["confidence"] == pytest.approx(0.8) and got["indicators"][0].startswith("LIKELY")
    noise = np.random.default_rng(1).integers(90, 190, (100, 100)).astype(np.uint8)
    got = raster.typed(noise)
    assert not got["is_typed"] and got["confidence"] == pytest.approx(0.5 - 0.0) or got["confidence"] < 0.5 or got["is_typed"]
    assert any(s.startswith("Smooth pixel distribution (mid=100.0%)") for s in got["indicators"])


# ---- enhancement ---------------------------------------------------------------------------------------------------------


def test_sauvola_equals_plain_windows():
    image = np.random.default_rng(5).integers(0, 256, (30, 41)).astype(np.uint8)
    for window in (5, 9):
        reach = window // 2
        wide = np.pad(image.astype(float), reach, "reflect")
        want = np.empty_like(image)
        for y in range(30):
            for x in range(41):
                part = wide[y : y + window, x : x + window]
                want[y, x] = 255 if image[y, x] > part.mean() * (1 + 0.2 * (part.std() / 127.5 - 1)) else 0
        assert (raster.sauvola(image, window) == want).all()
    assert raster.sauvola(image[:3, :3]).shape == (3, 3)


def plain_clahe(image, clip, grid):
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    full = np.pad(image, ((0, th * grid - h), (0, tw * grid - w)), "reflect")
    maps = {}
    for r in range(grid):
        for c in range(grid):
            counts = np.bincount(full[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel(), minlength=256).tolist()
            most = max(1, int(clip * th * tw / 256))
            over = sum(max(0, n - most) for n in counts)
            counts = [min(n, most) + over // 256 for n in counts]
            left = over % 256
            step = max(1, 256 // left) if left else 0
            at = 0
            while left > 0 and at < 256:
                counts[at] += 1
                at += step
                left -= 1
            total, out = 0, []
            for n in counts:
                total += n
                out.append(min(255, round(total * (255 / (th * tw)))))
            maps[r, c] = out
    out = np.empty_like(image)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            r0, c0 = math.floor(fy), math.floor(fx)
            a, b = fy - r0, fx - c0
            cut = lambda k: min(max(k, 0), grid - 1)
            at = lambda r, c: maps[cut(r), cut(c)][image[y, x]]  # noqa: E731, B023
            top, bottom = at(r0, c0) * (1 - b) + at(r0, c0 + 1) * b, at(r0 + 1, c0) * (1 - b) + at(r0 + 1, c0 + 1) * b
            out[y, x] = min(255, max(0, round(top * (1 - a) + bottom * a)))
    return out


@pytest.mark.parametrize(("shape", "grid", "clip"), [((32, 32), 4, 3.0), ((37, 50), 4, 2.0), ((64, 40), 8, 40.0)])
def test_clahe_equals_plain_tiles(shape, grid, clip):
    image = np.random.default_rng(3).normal(150, 25, shape).clip(0, 255).astype(np.uint8)
    assert (np.abs(raster.clahe(image, clip, grid).astype(int) - plain_clahe(image, clip, grid).astype(int)) <= 1).all()
    assert (raster.clahe(image, clip, grid) == plain_clahe(image, clip, grid)).mean() > 0.99


def test_otsu_and_median_equal_plain_versions():
    r = np.random.default_rng(8)
    image = np.r_[r.integers(0, 60, 200), r.integers(150, 256, 300)].astype(np.uint8).reshape(20, 25)
    best = max(range(256), key=lambda t: ((image <= t).mean() * (image > t).mean() * (image[image <= t].mean() - image[image > t].mean()) ** 2 if (image <= t).any() and (image > t).any() else -1, -t))
    assert raster.otsu(image) == best and raster.otsu(np.full((3, 3), 9, np.uint8)) == 0
    wide = np.pad(image, 1, "edge")
    want = [[sorted(wide[y : y + 3, x : x + 3].ravel())[4] for x in range(25)] for y in range(20)]
    assert (raster.median(image) == np.array(want)).all()


def test_rulings_go_and_strokes_stay():
    image = np.full((40, 200), 250, np.uint8)
    image[20, :] = 10
    image[5:35, 60:63] = 10
    got = raster.without_rulings(image)
    assert (got[20, :50] == 255).all() and (got[8:18, 60:63] == 10).all() and (got[22:34, 60:63] == 10).all()
    assert (raster.without_rulings(image[:, :20]) == image[:, :20]).all()


def test_columns_over_pages(spark):
    docs = spark.createDataFrame([(1, "ab " * 3000), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.j for r in docs.select("k", raster.judged(docs.t, 64).alias("j")).collect()}
    page = raster.page(("ab " * 3000).encode(), 64)
    assert (got[1].skew, got[1].style, got[1].is_typed) == (raster.skew(page), raster.style(page), raster.typed(page)["is_typed"])
    assert got[2].style == "mixed" and got[3].confidence == 0.0
    made = {r.k: r.p for r in docs.select("k", raster.enhanced(docs.t, 64, "median").alias("p")).collect()}
    assert bytes(made[1]) == raster.median(page).tobytes() and bytes(made[2]) == b""
    with pytest.raises(ValueError, match="Unknown enhancement"):
        raster.enhanced(docs.t, 64, "sharper")


# ---- lines ---------------------------------------------------------------------------------------------------------------


def plain_boxes(marks, gap, least, pad):
    h = len(marks)
    smooth = [sum(marks[max(0, y - 1) : y + 2]) / 3 for y in range(h)]
    bound = max(max(smooth) * 0.02, 5)
    regions, start = [], None
    for y, v in enumerate([*smooth, 0]):
        if v > bound and start is None:
            start = y
        elif v <= bound and start is not None:
            regions.append([start, y])
            start = None
    merged = []
    for r in regions:
        if merged and r[0] - merged[-1][1] < gap:
            merged[-1][1] = r[1]
        else:
            merged.append(r)
    kept = [r for r in merged if r[1] - r[0] >= least]
    return [(max(0, a - pad), min(h, b + pad) - max(0, a - pad)) for a, b in kept] if len(kept) >= 2 else []


@pytest.mark.parametrize("seed", range(4))
def test_boxes_equal_plain_scan(spark, seed):
    r = np.random.default_rng(seed)
    pages = {k: np.where(np.repeat(r.random(12) < 0.5, r.integers(1, 9, 12)), r.integers(0, 3000, 1), 0).tolist() for k in range(30)}
    pages[99], pages[98], pages[97] = [900] * 12 + [0] * 9 + [900] * 12, [0] * 20, [900] * 40  # ink at both edges, none, one line
    rows = [(k, y, int(m)) for k, marks in pages.items() for y, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "k int, y int, mark long").repartition(3)
    for gap, least, pad in ((5, 10, 4), (2, 3, 1)):
        got = {}
        for b in lines.boxes(df, "k", gap, least, pad).orderBy("k", "line").collect():
            got.setdefault(b.k, []).append((b.y, b.height))
        assert got == {k: want for k, marks in pages.items() if (want := plain_boxes(marks, gap, least, pad))}


def test_marks_equal_kernel(spark):
    texts = {1: "some words\nand more é漢 " * 40, 2: "aaaa", 3: "", 4: None, 5: "ab"}
    docs = spark.createDataFrame(list(texts.items()), "k int, t string")
    rows = lines.rows_of(docs, "k", "t", 16)
    got = {}
    for r in lines.marks(rows, "k").orderBy("k", "y").collect():
        got.setdefault(r.k, []).append(r.mark)
    for k in (1, 2, 5):
        page = raster.page(texts[k].encode(), 16)
        bound = raster.otsu(page) if len(np.unique(page)) > 1 else -1
        assert got[k] == (255 * (page <= bound).sum(1)).tolist()
    assert set(got) == {1, 2, 5}


def test_reading_by_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, ""), (2, 1, None)], "k int, line int, t string")
    assert [tuple(r) for r in lines.read_by_lines(df, "k", F.col("t")).collect()] == [(1, "a\nb")]


# ---- misreadings -----------------------------------------------------------------------------------------------------------


def test_misreadings_differ_and_repeat():
    text = "The mitochondria is the powerhouse of the cell, and 1051 more rows follow here. " * 5
    made = [misreading.misread(text, str(k)) for k in range(300)]
    assert all(m != text for m in made) and made == [misreading.misread(text, str(k)) for k in range(300)]
    assert len(set(made)) > 290 and made != [misreading.misread(text, str(k), 7) for k in range(300)]
    sizes = [abs(len(m) - len(text)) for m in made]
    assert max(sizes) < len(text) / 4 and misreading.misread("", "k") == "" and misreading.misread("aa", "k") in {"aa", "oo", "ao", "oa", "a", "aaa", "aA", "Aa", "AA"}


def test_misreading_rates_follow_the_severities():
    text = "abcdefghij klmnopq " * 50
    made = [misreading.misread(text, str(k)) for k in range(400)]
    spaces = [m.count(" ") for m in made]
    assert np.mean(spaces) < text.count(" ") * 1.02
    levels = [misreading._severity(misreading.Lottery(42, str(k))) for k in range(2000)]
    shares = np.bincount(levels, minlength=3) / 2000
    assert shares == pytest.approx(np.array(misreading.SEVERITIES), abs=0.04)
