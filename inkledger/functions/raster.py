"""Kernels over grey pages: arrays of 0 (ink) to 255 (paper), row after row, with a width.

One image at a time in Arrow batches, so memory is bounded by an image. ``page`` makes a page of a text: its UTF-8 bytes,
``width`` to a row, the last row filled up with paper.

Sides over ``LARGEST`` are reduced by box means before skew and style are judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from inkledger.functions.pieces import cuts, in_pieces

PAPER = 255
#: Bounds of the judgements.
LARGEST, INK_SHARE = 600, 0.75
ANGLES, ANGLE_STEP, LEAST_SKEW = 20, 0.25, 1.0
LONG_RUNS_CURSIVE, LONG_RUNS_PRINT = 0.25, 0.10
LEAST_SIDE, DARK, LIGHT, TYPED = 50, 80, 200, 0.5


def page(data: bytes, width: int) -> np.ndarray:
    """A text's bytes as a page of ``width`` columns."""
    raw = np.frombuffer(data, np.uint8)
    out = np.full(-(-len(raw) // width) * width, PAPER, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(-1, width)


def reduced(image: np.ndarray, largest: int = LARGEST) -> np.ndarray:
    """The image by box means, both sides at most ``largest``."""
    if max(image.shape) <= largest:
        return image
    ratio = largest / max(image.shape)
    h, w = (max(1, int(side * ratio)) for side in image.shape)
    rows, cols = (np.arange(n) * side // n for n, side in ((h, image.shape[0]), (w, image.shape[1])))
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, 0), cols, 1)
    sizes = np.outer(np.diff(np.r_[rows, image.shape[0]]), np.diff(np.r_[cols, image.shape[1]]))
    return np.round(sums / sizes).astype(np.uint8)


def ink(image: np.ndarray) -> np.ndarray:
    return image < image.mean() * INK_SHARE


# ---- skew --------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _turned(h: int, w: int, angle: float) -> np.ndarray:
    """For each place of the page turned by ``angle`` degrees (counter-clockwise, about its centre): the nearest place it shows, h * w outside the page."""
    turn = -math.radians(angle)
    cos, sin = math.cos(turn), math.sin(turn)
    x, y = (np.arange(w) + 0.5 - w / 2)[None, :], (np.arange(h) + 0.5 - h / 2)[:, None]
    col, row = np.floor(cos * x + sin * y + w / 2).astype(np.int64), np.floor(-sin * x + cos * y + h / 2).astype(np.int64)
    inside = (col >= 0) & (col < w) & (row >= 0) & (row < h)
    return np.where(inside, row * w + col, h * w).astype(np.int32)


def turn(image: np.ndarray, angle: float) -> np.ndarray:
    """The image turned by ``angle`` degrees, paper where it shows nothing."""
    return np.append(image.ravel(), np.uint8(PAPER))[_turned(*image.shape, angle)]


def skew_profile(image: np.ndarray) -> np.ndarray:
    """Variance of the ink per row at each of the tried angles, from the least one."""
    small = reduced(image)
    dark = np.append(ink(small).ravel(), False)
    return np.array([dark[_turned(*small.shape, k * ANGLE_STEP)].sum(1).var() for k in range(-ANGLES, ANGLES + 1)])


def skew(image: np.ndarray) -> float:
    """The angle whose rows differ most in ink, the first of several; 0 below ``LEAST_SKEW``, and where no angle has any."""
    return _angle(skew_profile(image)) if image.size else 0.0


def skews(images: list[np.ndarray], most: int = 1 << 20) -> list[float]:
    """``skew`` of each image; images of one shape are turned together, ``most`` places at a time, so that turns are worked out once a shape."""
    out, shapes = [0.0] * len(images), {}
    for k, image in enumerate(images):
        if image.size:
            small = reduced(image)
            shapes.setdefault(small.shape, []).append((k, np.append(ink(small).ravel(), False)))
    for (h, w), own in shapes.items():
        step = max(1, most // (h * w))
        by = np.empty((len(own), 2 * ANGLES + 1))
        dark = [np.stack([d for _, d in own[i : i + step]], 1).view(np.uint8) for i in range(0, len(own), step)]  # a place's values in all images side by side
        sums, rows = np.uint8 if w < 256 else np.int64, np.arange(0, h * w, w)
        for k in range(-ANGLES, ANGLES + 1):
            turned = _turned.__wrapped__(h, w, k * ANGLE_STEP).ravel()
            for i, d in zip(range(0, len(own), step), dark):
                by[i : i + step, k + ANGLES] = np.ascontiguousarray(np.add.reduceat(d.take(turned, 0), rows, 0, sums).T, np.int64).var(1)
        for (k, _), profile in zip(own, by):
            out[k] = _angle(profile)
    return out


def _angle(by: np.ndarray) -> float:
    angle = (int(np.argmax(by)) - ANGLES) * ANGLE_STEP if by.max() > 0 else 0.0
    return angle if abs(angle) >= LEAST_SKEW else 0.0


def deskewed(image: np.ndarray, angle: float | None = None) -> np.ndarray:
    angle = skew(image) if angle is None else angle
    return turn(image, angle) if angle else image


# ---- style and typed text ------------------------------------------------------------------------------------------------


def run_lengths(dark: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true along the rows."""
    edges = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return np.flatnonzero(edges.ravel() == -1) - np.flatnonzero(edges.ravel() == 1)


def style(image: np.ndarray) -> str:
    """print, cursive or mixed, by the share of ink runs over twice the mean run; mixed without ink."""
    runs = run_lengths(ink(reduced(image))) if image.size else np.zeros(0)
    if not len(runs):
        return "mixed"
    share = (runs > 2 * runs.mean()).mean()
    return "cursive" if share > LONG_RUNS_CURSIVE else "print" if share < LONG_RUNS_PRINT else "mixed"


def _variation(x: np.ndarray) -> float:
    return float(x.std() / x.mean()) if len(x) and x.mean() > 0 else 0.0


def typed(image: np.ndarray) -> dict:
    """is_typed, confidence and the indicators that spoke for or against typed text; rows and columns are seen every hundredth of a side."""
    h, w = image.shape
    if h < LEAST_SIDE or w < LEAST_SIDE:
        return {"is_typed": False, "confidence": 0.0, "indicators": ["Image too small for analysis"]}
    x, said, score = image.astype(np.float64), [], 0.0
    rows = _variation(x[:: max(1, h // min(h, 100))].var(1))
    if rows < 0.4:
        score += 0.3
        said.append(f"Row variance is very uniform (CV={rows:.2f}) -- typical of typed text")
    elif rows < 0.7:
        score += 0.1
        said.append(f"Row variance is moderately uniform (CV={rows:.2f})")
    else:
        said.append(f"Row variance is irregular (CV={rows:.2f}) -- typical of handwriting")
    upto = np.cumsum(np.bincount(image.ravel(), minlength=256)) / image.size
    dark, light = upto[DARK - 1], 1 - upto[LIGHT - 1]
    middle = upto[LIGHT - 1] - upto[DARK - 1]
    if middle < 0.15 and dark > 0.05 and light > 0.5:
        score += 0.35
        said.append(f"Strongly bimodal pixel distribution (mid={middle:.1%}) -- typical of typed/printed text")
    elif middle < 0.25:
        score += 0.15
        said.append(f"Somewhat bimodal pixel distribution (mid={middle:.1%})")
    else:
        said.append(f"Smooth pixel distribution (mid={middle:.1%}) -- typical of handwriting or photos")
    columns = _variation((PAPER - x[:, :: max(1, w // 100)]).sum(0))
    if columns < 0.3:
        score += 0.2
        said.append(f"Very even horizontal ink distribution (CV={columns:.2f}) -- suggests typed/printed text")
    elif columns > 0.6:
        said.append(f"Uneven horizontal ink distribution (CV={columns:.2f}) -- suggests handwriting")
    if x.std() > 60 and middle < 0.2:
        score += 0.15
        said.append(f"High contrast (std={x.std():.1f}) with clean background")
    sure = min(score, 1.0)
    verdict = "LIKELY TYPED/PRINTED TEXT DETECTED" if sure >= TYPED else "Text appears to be handwritten"
    return {"is_typed": sure >= TYPED, "confidence": round(sure, 3), "indicators": [verdict, *said]}


# ---- enhancement ---------------------------------------------------------------------------------------------------------


def _window_sums(x: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the (2 reach + 1)^2 window about each place of ``x``, mirrored at its edges, by a summed-area table."""
    mode = "reflect" if min(x.shape) > reach else "symmetric"
    table = np.pad(np.pad(x, reach, mode).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * reach + 1
    return table[k:, k:] - table[:-k, k:] - table[k:, :-k] + table[:-k, :-k]


def sauvola(image: np.ndarray, window: int = 25, k: float = 0.2, half_range: float = 127.5) -> np.ndarray:
    """Black and white by local mean m and deviation s: paper where a pixel exceeds m (1 + k (s / half_range - 1))."""
    x, n = image.astype(np.float64), window * window
    mean = _window_sums(x, window // 2) / n
    deviation = np.sqrt(np.maximum(_window_sums(x * x, window // 2) / n - mean * mean, 0))
    return np.where(x > mean * (1 + k * (deviation / half_range - 1)), 255, 0).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = 3.0, grid: int = 8) -> np.ndarray:
    """Equalised contrast by tiles: each tile's histogram is clipped, the excess dealt out evenly, and neighbouring tiles' maps are blended."""
    h, w = image.shape
    th, tw = -(-h // grid), -(-w // grid)
    mode = "reflect" if h > grid * th - h and w > grid * tw - w else "symmetric"
    full = np.pad(image, ((0, th * grid - h), (0, tw * grid - w)), mode)
    tile = (np.arange(th * grid) // th)[:, None] * grid + (np.arange(tw * grid) // tw)[None, :]
    counts = np.bincount((tile * 256 + full).ravel(), minlength=grid * grid * 256).reshape(-1, 256)
    most = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    left = over % 256
    stride = np.maximum(1, 256 // np.maximum(left, 1))
    value = np.arange(256)[None, :]
    counts += ((value % stride[:, None] == 0) & (value // stride[:, None] < left[:, None])).astype(counts.dtype)
    maps = np.clip(np.round(counts.cumsum(1) * (255 / (th * tw))), 0, 255).reshape(grid, grid, 256)

    def between(size: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.0) / side - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low, 0, grid - 1), np.clip(low + 1, 0, grid - 1), at - low

    r0, r1, fr = between(h, th)
    c0, c1, fc = between(w, tw)
    of = lambda r, c: maps[r[:, None], c[None, :], image]
    top, bottom = of(r0, c0) * (1 - fc) + of(r0, c1) * fc, of(r1, c0) * (1 - fc) + of(r1, c1) * fc
    return np.clip(np.round(top * (1 - fr)[:, None] + bottom * fr[:, None]), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The value that parts ink (up to it) from paper with the largest variance between both, the least of several."""
    n = np.bincount(image.ravel(), minlength=256).astype(np.int64)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    total, mass = int(n0[-1]), int(s0[-1])
    parts = n0 * (total - n0)
    apart = (s0 * total - n0 * mass).astype(np.float64)
    return int(np.argmax(np.where(parts > 0, apart * apart / np.maximum(parts, 1), -1.0)))


def _runs_of(x: np.ndarray, size: int) -> np.ndarray:
    """Whether each stretch of ``size`` places along the rows is all true."""
    upto = np.pad(x.cumsum(1, dtype=np.int32), ((0, 0), (1, 0)))
    return upto[:, size:] - upto[:, :-size] == size


def _all(x: np.ndarray, size: int) -> np.ndarray:
    """Whether all ``size`` places about each one along the rows are true, places outside left out; even sizes reach further back."""
    return _runs_of(np.pad(x, ((0, 0), (size // 2, size - 1 - size // 2)), constant_values=True), size)


def without_rulings(image: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Long horizontal strokes whitened: dark stretches of ``share`` of the width or more (30 places at least), a place above and below too."""
    size = max(30, int(image.shape[1] * share))
    if not image.size or size > image.shape[1]:
        return image
    kept = image <= otsu(image)
    for _ in range(2):  # shrink twice
        kept = kept & _all(kept, size)
        if not kept.any():
            return image
    back = size - 1 - size // 2
    for _ in range(2):  # and grow back
        wide = np.pad(kept, ((0, 0), (back, size // 2)))
        kept = ~_runs_of(~wide, size)
    tall = np.pad(kept, ((1, 1), (0, 0)))
    lines = tall[:-2] | tall[1:-1] | tall[2:]
    return np.where(lines, PAPER, image)


def median(image: np.ndarray, size: int = 3) -> np.ndarray:
    """The middle value of each ``size`` x ``size`` window, edges repeated."""
    wide = np.pad(image, size // 2, "edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (size, size)), (-2, -1)).astype(np.uint8)


# ---- columns -------------------------------------------------------------------------------------------------------------


def _pages(texts: pd.Series, width: int):
    for t in texts:
        yield page((t or "").encode(), width)


def judged(body: Column, width: int) -> Column:
    """struct(skew, style, is_typed, confidence, indicators) of each text's page."""

    def run(texts: pd.Series) -> pd.DataFrame:
        pages = list(_pages(texts, width))
        return pd.DataFrame([{"skew": a, "style": style(p), **typed(p)} for p, a in zip(pages, skews(pages))], columns=["skew", "style", "is_typed", "confidence", "indicators"])

    return in_pieces(lambda: run, "skew double, style string, is_typed boolean, confidence double, indicators array<string>")(body)


def skewed(body: Column, width: int) -> Column:
    """The skew of each text's page alone."""
    return in_pieces(lambda: lambda texts: pd.Series(skews(list(_pages(texts, width))), dtype=float), "double")(body)


def styled(body: Column, width: int) -> Column:
    """struct(style, is_typed, confidence) of each text's page, without its skew."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"style": style(p), **typed(p)} for p in _pages(texts, width)], columns=["style", "is_typed", "confidence"])

    return in_pieces(lambda: run, "style string, is_typed boolean, confidence double")(body)


#: Ways to enhance a page, by name.
ENHANCED = {"sauvola": sauvola, "clahe": clahe, "without_rulings": without_rulings, "median": median, "deskewed": deskewed}


def enhanced(body: Column, width: int, how: str) -> Column:
    """binary: the pixels of each text's page after an enhancement."""
    if how not in ENHANCED:
        raise ValueError(f"Unknown enhancement: {how}. Use: {', '.join(ENHANCED)}")
    change = ENHANCED[how]
    return in_pieces(lambda: lambda texts: pd.Series([change(p).tobytes() if p.size else b"" for p in _pages(texts, width)], dtype=object), "binary")(body)


def _all_changes(pages: list[np.ndarray]) -> Iterator[tuple[int, str, bytes]]:
    """(place, how, pixels) after each enhancement; pages of one shape are turned together."""
    for k, (p, angle) in enumerate(zip(pages, skews(pages))):
        for how in sorted(ENHANCED):
            done = p if not p.size else deskewed(p, angle) if how == "deskewed" else ENHANCED[how](p)
            yield k, how, done.tobytes()


def all_enhanced(texts: DataFrame, key: str, body: str, width: int, most: int = 1 << 22) -> DataFrame:
    """(key, how, pixels) after each enhancement of each text's page; some ``most`` bytes are held at a time."""

    def rows(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        keys, hows, pixels = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(hows, pa.string()), pa.array(pixels, pa.binary())], names=[key, "how", "pixels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False) + width
            for i, j in cuts(sizes.tolist(), most, len(batch)):
                done, held = [], 0
                for k, how, pixels in _all_changes(list(_pages(batch.column(1).slice(i, j - i).to_pylist(), width))):
                    done.append((i + k, how, pixels))
                    held += len(pixels)
                    if held > most:
                        yield rows(batch, done)
                        done, held = [], 0
                yield rows(batch, done)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, body).mapInArrow(run, f"`{key}` {kind}, how string, pixels binary")
