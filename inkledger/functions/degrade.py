"""Seeded degradations of grey pages, for measuring how readings suffer: noise, low contrast, blur, crop, perspective, elastic bends.

A variant is one row (``variants`` explodes a page's row by kind and strength), and every kernel works on one page at a time. Draws
come from a Philox stream keyed by seed, key and kind, so a variant is the same in every run and on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.pieces import in_pieces
from inkledger.functions.raster import PAPER, page


def stream(seed: int, key: str, kind: str) -> np.random.Generator:
    digest = hashlib.blake2b(f"{seed}/{key}/{kind}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def sampled(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The image at fractional places, between its four neighbours; paper outside."""
    h, w = image.shape
    wide = np.full((h + 2, w + 2), PAPER, np.float64)
    wide[1:-1, 1:-1] = image
    r, c = np.clip(rows + 1, 0, h + 1), np.clip(cols + 1, 0, w + 1)
    r0, c0 = np.minimum(r.astype(np.int64), h), np.minimum(c.astype(np.int64), w)
    fr, fc = r - r0, c - c0
    flat, at, left = wide.ravel(), r0 * (w + 2) + c0, 1 - fc
    top, bottom = flat.take(at) * left + flat.take(at + 1) * fc, flat.take(at + w + 2) * left + flat.take(at + w + 3) * fc
    return np.clip(np.round(top * (1 - fr) + bottom * fr), 0, 255).astype(np.uint8)


def box(x: np.ndarray, reach: int) -> np.ndarray:
    """Means over (2 reach + 1)^2 windows of the last two axes, edges repeated, by running sums along each axis."""
    k = 2 * reach + 1
    h, w = x.shape[-2:]
    sums = np.cumsum(np.take(x, np.clip(np.arange(-reach - 1, h + reach), 0, h - 1), -2), -2)
    x = (sums[..., k:, :] - sums[..., :-k, :]) / k
    sums = np.cumsum(np.take(x, np.clip(np.arange(-reach - 1, w + reach), 0, w - 1), -1), -1)
    return (sums[..., k:] - sums[..., :-k]) / k


def noise(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """Normal noise of deviation 50 x strength."""
    return np.clip(np.round(image + draw.normal(0, 50 * strength, image.shape)), 0, 255).astype(np.uint8)


def low_contrast(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """Values drawn towards the mean by ``strength``."""
    mean = image.mean()
    return np.clip(np.round(mean + (image - mean) * (1 - strength)), 0, 255).astype(np.uint8)


def blur(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """Box means of a reach that grows with ``strength``, twice."""
    reach = max(1, int(round(4 * strength)))
    return np.clip(np.round(box(box(image.astype(np.float64), reach), reach)), 0, 255).astype(np.uint8)


def crop(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """The centre, without strength / 2 of each side, stretched back to the page's size."""
    h, w = image.shape
    keep = 1 - strength
    rows, cols = ((np.arange(n) + 0.5) * keep + n * strength / 2 - 0.5 for n in (h, w))
    return sampled(image, *np.broadcast_arrays(rows[:, None], cols[None, :]))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others (x, y), its last entry 1."""
    a, b = np.zeros((8, 8)), target.reshape(-1)
    for k, ((x, y), (u, v)) in enumerate(zip(source, target)):
        a[2 * k] = [x, y, 1, 0, 0, 0, -u * x, -u * y]
        a[2 * k + 1] = [0, 0, 0, x, y, 1, -v * x, -v * y]
    return np.append(np.linalg.solve(a, b), 1.0).reshape(3, 3)


def perspective(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """Each corner moves inwards by up to strength / 4 of its side; the page is seen through the map of the corners."""
    h, w = image.shape
    if h < 2 or w < 2:
        return image
    corners = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    inwards = np.array([(1, 1), (-1, 1), (-1, -1), (1, -1)])
    moved = corners + inwards * draw.random((4, 2)) * strength / 4 * np.array([w - 1, h - 1])
    back = homography(moved, corners)
    x, y = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    u, v, z = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in range(3))
    return sampled(image, v / z, u / z)


def elastic(image: np.ndarray, draw: np.random.Generator, strength: float) -> np.ndarray:
    """Places moved by a smooth random field: uniform draws, box-filtered three times, scaled to 10 x strength places at most."""
    h, w = image.shape
    field = draw.uniform(-1, 1, (2, h, w))
    reach = max(1, min(8, min(h, w) // 4))
    for _ in range(3):
        field = box(field, reach)
    for k in range(2):
        most = np.abs(field[k]).max()
        field[k] *= 10 * strength / most if most > 0 else 0
    rows, cols = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    return sampled(image, rows + field[0], cols + field[1])


Kernel = Callable[[np.ndarray, np.random.Generator, float], np.ndarray]
KINDS: dict[str, Kernel] = {"noise": noise, "low_contrast": low_contrast, "blur": blur, "crop": crop, "perspective": perspective, "elastic": elastic}
#: Strength of each kind where none is given.
STRENGTHS = {"noise": 0.5, "low_contrast": 0.6, "blur": 0.5, "crop": 0.2, "perspective": 0.4, "elastic": 0.4}


def degraded(image: np.ndarray, key: str, kind: str, strength: float, seed: int = 42) -> np.ndarray:
    if kind not in KINDS:
        raise ValueError(f"Unknown degradation: {kind}. Use: {', '.join(KINDS)}")
    return KINDS[kind](image, stream(seed, key, kind), strength) if image.size else image


def degrade(body: Column, key: Column, kind: Column, strength: Column, width: int, seed: int = 42) -> Column:
    """binary: the pixels of each text's page after a degradation; null text: an empty page."""

    def run(texts: pd.Series, keys: pd.Series, kinds: pd.Series, strengths: pd.Series) -> pd.Series:
        return pd.Series([degraded(page((t or "").encode(), width), str(k), how, s, seed).tobytes() for t, k, how, s in zip(texts, keys, kinds, strengths)], dtype=object)

    return in_pieces(lambda: run, "binary", 4)(body, key.cast("string"), kind, strength)


def variants(pages: DataFrame, key: str, body: str, width: int, kinds: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(key, kind, strength, pixels): one row for each page and degradation."""
    chosen = STRENGTHS if kinds is None else kinds
    unknown = sorted(set(chosen) - set(KINDS))
    if unknown:
        raise ValueError(f"Unknown degradation: {unknown[0]}. Use: {', '.join(KINDS)}")
    plan = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(float(s)).alias("strength")) for k, s in sorted(chosen.items())))
    rows = pages.select(key, F.col(body).alias("body_"), F.explode(plan).alias("p")).select(key, "body_", "p.kind", "p.strength")
    return rows.select(key, "kind", "strength", degrade(F.col("body_"), F.col(key), F.col("kind"), F.col("strength"), width, seed).alias("pixels"))
