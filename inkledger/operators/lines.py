"""Text lines of pages, found from the ink of their rows: by DataFrame functions over rows, or page by page.

A page is a text's UTF-8 bytes, ``width`` to a row. Its ink threshold parts the histogram with the largest variance between
ink and paper; a row's mark is 255 for each place at or under it. Marks are smoothed over three rows, rows over 2 % of
the peak (5 at least) are text, stretches less than ``gap`` rows apart are one, those under ``least`` rows high go, and
each line gets ``pad`` rows above and below. A page with fewer than two lines has none.

Windows run over the rows of one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.functions.raster import otsu, page

#: Least gap between lines, least height of a line, padding; the peak's share and the least mark of text rows.
GAP, LEAST, PAD, SHARE, FLOOR = 5, 10, 4, 0.02, 5


def rows_of(texts: DataFrame, key: str, body: str, width: int) -> DataFrame:
    """(key, y, values): the rows of each text's page from the top, their pixels as numbers; the last row is filled up with paper."""
    # Latin-1 makes a character of each byte; one pass makes numbers of them, and rows are slices
    latin = F.decode(F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8"), "ISO-8859-1")
    pages = texts.select(key, F.transform(F.filter(F.split(latin, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch)).alias("p_")).where(F.size("p_") > 0)
    last = F.ceil(F.size("p_") / width).cast("int") - 1
    rows = pages.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda y: F.slice("p_", y * width + 1, F.lit(width)))).alias("y", "part_"))
    return rows.select(key, "y", F.concat("part_", F.array_repeat(F.lit(255), F.lit(width) - F.size("part_"))).alias("values"))


def thresholds(rows: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the value up to which a pixel is ink, the least that parts a page's values best."""
    counts = rows.select(key, F.explode("values").alias("v")).groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(key)
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(key, "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(own).alias("total"), F.sum(F.col("n") * F.col("v")).over(own).alias("mass"))
    apart = (F.col("s0") * F.col("total") - F.col("n0") * F.col("mass")).cast("double")
    parts = (F.col("n0") * (F.col("total") - F.col("n0"))).cast("double")
    between = F.when(parts > 0, apart * apart / parts).otherwise(F.lit(-1.0))
    best = counts.select(key, F.struct(between.alias("b"), (-F.col("v")).alias("less")).alias("best"), "total", "n0", "v").groupBy(key).agg(F.max("best").alias("best"))
    # a page of one value has no two parts: nothing of it is ink
    return best.select(key, F.when(F.col("best.b") >= 0, -F.col("best.less")).otherwise(F.lit(-1)).cast("int").alias("threshold"))


def marks(rows: DataFrame, key: str) -> DataFrame:
    """(key, y, mark) of every row."""
    dark = F.expr("255 * aggregate(values, 0, (n, v) -> n + if(v <= threshold, 1, 0))")
    return rows.join(thresholds(rows, key), key).select(key, "y", dark.cast("long").alias("mark"))


def boxes(marked: DataFrame, key: str, gap: int = GAP, least: int = LEAST, pad: int = PAD) -> DataFrame:
    """(key, line, y, height) of the lines of each page, from (key, y, mark) of all of its rows."""
    page, down = Window.partitionBy(key), Window.partitionBy(key).orderBy("y")
    near = lambda f: F.coalesce(f("mark", 1).over(down), F.lit(0))
    rows = marked.select(key, "y", (near(F.lag) + F.col("mark") + near(F.lead)).alias("sum3"), F.count(F.lit(1)).over(page).alias("rows_"))
    floor = F.greatest(F.max("sum3").over(page) / 3 * SHARE, F.lit(float(FLOOR)))
    inked = rows.withColumn("floor_", floor).where(F.col("sum3") / 3 > F.col("floor_"))
    # text rows less than ``gap`` empty rows apart belong to one line
    opens = F.coalesce(F.col("y") - F.lag("y").over(down) - 1 >= gap, F.lit(True))
    inked = inked.withColumn("own_", F.sum(opens.cast("int")).over(down))
    lines = inked.groupBy(key, "own_").agg(F.min("y").alias("top"), (F.max("y") + 1).alias("end"), F.first("rows_").alias("rows_")).where(F.col("end") - F.col("top") >= least)
    lines = lines.withColumn("lines_", F.count(F.lit(1)).over(page)).where("lines_ >= 2")
    above, below = F.greatest(F.lit(0), F.col("top") - pad), F.least(F.col("rows_"), F.col("end") + pad)
    number = F.row_number().over(Window.partitionBy(key).orderBy("top"))
    return lines.select(key, number.alias("line"), above.cast("int").alias("y"), (below - above).cast("int").alias("height"))


def of_pages(texts: DataFrame, key: str, body: str, width: int, gap: int = GAP, least: int = LEAST, pad: int = PAD) -> DataFrame:
    """``boxes`` of each text's page, page by page: rows never leave their task, and only lines come out."""

    def found(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, end) of the lines."""
        ink = int(otsu(image)) if image.min() < image.max() else -1
        mark = 255 * (image <= ink).sum(1, dtype=np.int64)
        sum3 = np.pad(mark, 1)
        sum3 = sum3[:-2] + mark + sum3[2:]
        y = np.flatnonzero(sum3 / 3 > max(sum3.max() / 3 * SHARE, float(FLOOR)))
        first = np.flatnonzero(np.r_[True, np.diff(y) - 1 >= gap]) if len(y) else np.zeros(0, np.int64)
        top, end = y[first], y[np.r_[first[1:], len(y)] - 1] + 1 if len(y) else y
        high = end - top >= least
        return top[high], end[high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tops, ends, sizes = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                image = page((text.as_py() or "").encode(), width)
                top, end = found(image) if len(image) else ((), ())
                if len(top) >= 2:
                    at.append(k), tops.append(top), ends.append(end), sizes.append(len(image))
            if not at:
                continue
            n = [len(x) for x in tops]
            rows, y = np.repeat(sizes, n), np.maximum(0, np.concatenate(tops) - pad)
            columns = [np.concatenate([np.arange(1, k + 1) for k in n]), y, np.minimum(rows, np.concatenate(ends) + pad) - y]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, n))), *(pa.array(x.astype(np.int32)) for x in columns)], names=[key, "line", "y", "height"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, body).mapInArrow(run, f"`{key}` {kind}, line int, y int, height int")


def read_by_lines(lines: DataFrame, key: str, reading: Column) -> DataFrame:
    """(key, text): the readings of a page's lines, from the top, without the empty ones; ``lines`` has key and line."""
    rows = lines.select(key, "line", F.trim(F.coalesce(reading, F.lit(""))).alias("reading_")).where("reading_ <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line", "reading_")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["reading_"]), "\n").alias("text"))
