"""Document fingerprints: quartile bucket digests that stay close when texts are close.

Each window of four bytes adds the triplets (1,2,3), (1,2,4) and (1,3,4), hashed, to 256 buckets. The digest holds
the text's length on a log scale and, for each bucket, the quartile of its count among all counts, as two bits.
The difference of two digests adds up quartile steps (three for opposite ends) and the lengths' steps, bounded by
``FAR``; likeness is one less the difference's share of ``FAR``.

Defined cases: null or empty text: n_chars 0 and a digest of no counts. Texts under four bytes: only length and the
bytes' own sum count. Equal texts have equal digests. "Next" follows ascending doc_id, then text; after the last
comes the first; a lone document is its own next. Rows without a doc_id come first. Repeated rows follow each other.
A very long text is digested whole, in a piece of its own. Empty table: empty result. Only doc_id and text are read,
so other columns may have any name.

Scale: neighbours meet without sorting everything in one place. The driver picks range edges from quantiles of the
ids (as many as ranges), each range also gets the next range's first document through a broadcast of one row a range,
and a task walks its ranges in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c

BUCKETS = 256
#: Bound of the difference score: unlike texts of this kind differ by about two thirds of a step a bucket.
FAR = 256.0
LENGTH_STEP = 4.0


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``1 + BUCKETS`` bytes for each text: log length, then quartiles 0..3."""
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS), np.int64)
    length = np.diff(offsets)
    if len(data) >= 4:
        row = np.repeat(np.arange(n), length)
        same = row[:-3] == row[3:]
        d = data.astype(np.uint32)
        row = row[:-3][same]
        for a, b, e, salt in ((0, 1, 2, 1), (0, 1, 3, 3), (0, 2, 3, 5)):
            m = len(data) - 3
            x = (d[a : a + m] << np.uint32(16) | d[b : b + m] << np.uint32(8) | d[e : e + m])[same]
            x = (x + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            x = (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA77)
            counts += np.bincount(row * BUCKETS + (x >> np.uint32(24)), minlength=n * BUCKETS).reshape(n, BUCKETS)
    for k in np.flatnonzero((length > 0) & (length < 4)):
        counts[k, int(data[offsets[k] : offsets[k + 1]].astype(np.int64) @ [1, 7, 31][: length[k]]) % BUCKETS] += 1
    edges = np.sort(counts, axis=1)[:, [BUCKETS // 4, BUCKETS // 2, BUCKETS * 3 // 4]]
    quartile = (counts[:, :, None] > edges[:, None, :]).sum(axis=2)
    log_length = np.round(np.log2(length + 1) * 8)
    return np.c_[log_length, quartile].astype(np.uint8)


def texts_of(digest: np.ndarray) -> list[str]:
    """Digests as hex strings: length, then four buckets a byte."""
    q = digest[:, 1:].reshape(len(digest), BUCKETS // 4, 4)
    packed = q[:, :, 0] | q[:, :, 1] << 2 | q[:, :, 2] << 4 | q[:, :, 3] << 6
    return [x.tobytes().hex() for x in np.c_[digest[:, :1], packed].astype(np.uint8)]


def parse(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.r_[raw[:1], (raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of digests, 0 to 1."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    step = np.abs(a[:, 1:] - b[:, 1:])
    length = np.maximum(0, np.abs(a[:, 0] - b[:, 0]) / LENGTH_STEP - 1)
    difference = np.where(step == 3, 4, step).sum(axis=1) + length
    return 1 - np.minimum(difference, FAR) / FAR


def _of(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return digests(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple], last: tuple | None) -> pa.RecordBatch:
        chain = [*rows, *([last] if last else [])]
        own = [(r, s) for r, s in zip(chain, chain[1:]) if r[0] == s[0] and not r[1]]
        texts, after = [r[3] for r, _ in own], [s[3] for _, s in own]
        new = [edited(a, b) for a, b in zip(texts, after)]
        x, y, z = _of(texts), _of(new), _of(after)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in new]
        cols = [pa.array([r[2] for r, _ in own], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()), pa.array(texts_of(x), pa.string()), pa.array(texts_of(y), pa.string()), pa.array(likeness(x, y), pa.float64()), pa.array(likeness(x, z), pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("range", "ahead", "doc_id", "text"))):
            held.append(row)
            size += len(row[3])
            if size > c.CHUNK_BYTES:
                yield done(held[:-1], held[-1])
                held, size = held[-1:], len(held[-1][3])
    if held:
        yield done(held, None)


def _range_of(edges: np.ndarray):
    """The range of an id among sorted edges, -1 for null; only ids go to Python, and the plan does not grow with the ranges."""
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), -1, np.int32)
        out[known] = np.searchsorted(edges, ids[known].to_numpy().astype(np.int64), "right")
        return pd.Series(out)

    return place


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = ranges or 4 * c.partitions(spark)
    cuts = base.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges)).head()[0] or []
    rows = base.withColumn("range", _range_of(np.array(sorted(set(cuts)), np.int64))(F.col("doc_id")))
    first = {r.range: r.first for r in rows.select("doc_id", "range").groupBy("range").agg(F.min("doc_id").alias("first")).collect()}  # one row a range
    order = sorted(first)
    starts = [(k, first[k], order[i - 1]) for i, k in enumerate(order)]  # the first range comes after the last
    heads = F.broadcast(spark.createDataFrame(starts, "range int, first long, before int"))
    rows = rows.join(heads, "range")
    goes = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))))
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")))
    rows = rows.select("doc_id", "text", F.explode(F.when(goes.isNull(), own).otherwise(F.concat(own, goes))).alias("to"))
    dealt = rows.select("to.*", "doc_id", "text").repartition(c.partitions(spark), "range").sortWithinPartitions("range", "ahead", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
