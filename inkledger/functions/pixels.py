"""Quality measures of grey images: pixels as an array of 0..255, row after row, with a width. Arrow-batched numpy; one image at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white, and the share of white pixels of a blank page.
WHITE, BLANK = 245, 0.97


def measures(pixels: np.ndarray, width: int) -> dict:
    """blur (variance of the Laplacian, clipped to a byte around 128, borders as they are), contrast (95th less 5th percentile), mean, deviation, white share."""
    if not len(pixels):
        return {"blur": 0.0, "contrast": 0.0, "mean": 0.0, "deviation": 0.0, "white": 0.0}
    image = pixels.reshape(-1, width).astype(np.int64)
    edges = image.copy()
    if min(image.shape) > 2:
        around = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:]
        edges[1:-1, 1:-1] = np.clip(around - 4 * image[1:-1, 1:-1] + 128, 0, 255)
    upto = np.cumsum(np.bincount(pixels, minlength=256))
    low, high = (int(np.argmax(upto >= len(pixels) * share)) for share in (0.05, 0.95))
    return {"blur": round(float(edges.var()), 2), "contrast": round((high - low) / 255, 3), "mean": round(float(pixels.mean()), 1), "deviation": round(float(pixels.std()), 1), "white": float((pixels >= WHITE).mean())}


def quality(pixels: Column, width: Column) -> Column:
    """struct(blur, contrast, mean, deviation, white)."""

    @F.pandas_udf("blur double, contrast double, mean double, deviation double, white double")
    def run(p: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(np.asarray(x, np.int64), int(k)) for x, k in zip(p, w)], columns=["blur", "contrast", "mean", "deviation", "white"])

    return run(pixels, width)


def is_blank(pixels: Column) -> Column:
    """Whether a page is white but for a few pixels; not where there are none."""
    white = F.size(F.filter(pixels, lambda x: x >= WHITE))
    return F.when(F.size(pixels) == 0, False).otherwise(white / F.nullif(F.size(pixels), F.lit(0)) >= BLANK)


def ink_runs(pixels: Column, threshold: int = 128) -> Column:
    """array<struct(start, length)> of the stretches darker than ``threshold``, by one fold over the pixels."""
    none = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(none.alias("runs"), F.lit(-1).alias("open"), F.lit(0).alias("at"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] >= 0, F.array_append(acc["runs"], F.struct(acc["open"].alias("start"), (acc["at"] - acc["open"]).alias("length")))).otherwise(acc["runs"])

    def step(acc: Column, x: Column) -> Column:
        dark = x < threshold
        return F.struct(F.when(dark, acc["runs"]).otherwise(closed(acc)).alias("runs"), F.when(dark & (acc["open"] < 0), acc["at"]).when(dark, acc["open"]).otherwise(-1).alias("open"), (acc["at"] + 1).alias("at"))

    return F.aggregate(pixels, start, step, closed)
