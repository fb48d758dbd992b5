"""Shared plumbing of the training-data operators.

* ``write_table`` cuts lineage through a Parquet table in the shared folder that the session names in
  ``spark.checkpoint.dir`` (never a machine-local folder on a cluster, never ``localCheckpoint``).
* ``text_chunks`` views Arrow text columns as byte buffers, in pieces of bounded size.
* ``Packer`` deals fixed-width records out to buckets as column-wise packed blobs, so that an exchange moves a
  few rows per task and bucket instead of one row per record.

Documents are identified by ``(doc_id, ver)`` where ``ver`` is the crc32 of the text: rows equal in both are
repeats of one document and get equal results; rows that share a doc_id but not the text are separate documents.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 19
#: Words are maximal runs of anything but these bytes.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine (tests, bench) that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that this process wrote and has not deleted.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/inkledger/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def tables_written() -> int:
    return len(_written)


def delete_tables(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written after the first ``since``, but for ``keep``; call it once results that read them are consumed."""
    kept = getattr(keep, "written_path", None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[since:]:
        if path != kept:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    _written[since:] = [kept] if kept in _written[since:] else []


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if a column has it already."""
    taken = {k.lower() for k in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame):
    """All columns in one struct, so that no other name can clash with theirs."""
    return F.struct(*(F.col(f"`{k}`") for k in df.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def docs_with_version(docs: DataFrame) -> DataFrame:
    """doc_id, ver, text (null: empty) and nothing else."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(text).alias("ver"))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) of pieces with about ``limit`` bytes; a longer text is a piece of its own."""
    array = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = array.buffers()[2] if len(array) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def column(batch: pa.RecordBatch, name: str, kind=np.int64) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, owner row) of each word in a byte buffer cut into texts by ``offsets``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Arrow) -> Arrow:
    """``run``, and at its end the worker's free memory goes back to the system: workers idle or serve other tasks after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


# ---- rolling hashes ------------------------------------------------------------------------------------------

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    base = pow(_ODD[which], -1, 1 << 64) if inverse else _ODD[which]
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got)
        if len(got) <= CHUNK_BYTES * 2:
            _POWERS[which, inverse] = got
    return got[:n]


class Rolling:
    """Polynomial hashes, modulo 2^64, of every stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.n, self.which = len(symbols), which
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * _powers(self.n, which), out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers(self.n + 1, self.which, True)[start])

    def grams(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * _powers(self.n + 1, self.which, True)[: self.n - k + 1])


#: A fixed random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


#: Bytes whose words are hashed together.
HASH_BYTES = 1 << 19


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty) word: the sum of its bytes, each scrambled together with its place in the word.

    Powers of a base modulo 2^64 would not do: long words of a regular build agree under all of them.
    """
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):  # some bytes of a long text at a time, cut between words
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        size = ends[at:end] - starts[at:end]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        value = BYTE_VALUE[data[np.repeat(starts[at:end], size) + place]]
        value += place.astype(np.uint64) * np.uint64(_ODD[0])
        out[at:end] = mix(np.add.reduceat(mix(value), first) ^ size.astype(np.uint64))
        at = end
    return out


# ---- packed exchange -----------------------------------------------------------------------------------------

PACKED = "bucket int, payload binary"


class Packer:
    """Collects fixed-width records and yields ``PACKED`` batches, one blob for each bucket, whenever ``limit`` records are there."""

    def __init__(self, fields: Sequence[tuple[str, str]], buckets: int, limit: int = 200_000):
        self.fields, self.buckets, self.limit = list(fields), buckets, limit
        self.held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.count = 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((mix(key.astype(np.uint64)) % np.uint64(self.buckets), [c.astype(kind, copy=False) for c, (_, kind) in zip(columns, self.fields, strict=True)]))
            self.count += len(key)
        if self.count >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        bucket = np.concatenate([b for b, _ in self.held]).astype(np.int32)
        columns = [np.concatenate([c[i] for _, c in self.held]) for i in range(len(self.fields))]
        self.held, self.count = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[at[1:], len(bucket)]
        blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])


def unpack(fields: Sequence[tuple[str, str]], payload: bytes) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    n, out, at = len(payload) // width, {}, 0
    for name, kind in fields:
        out[name] = np.frombuffer(payload, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def unpacked(batches: Iterator[pa.RecordBatch], fields: Sequence[tuple[str, str]], limit: int = 500_000) -> Iterator[dict[str, np.ndarray]]:
    """Records of a task's blobs, joined to pieces of about ``limit`` records."""
    held: list[dict[str, np.ndarray]] = []
    count = 0
    first = fields[0][0]

    def joined() -> dict[str, np.ndarray]:
        return {name: np.concatenate([h[name] for h in held]) for name, _ in fields}

    for batch in batches:
        for blob in batch.column("payload"):
            held.append(unpack(fields, blob.as_py()))
            count += len(held[-1][first])
            if count >= limit:
                yield joined()
                held, count = [], 0
    if held:
        yield joined()


def exchange(df: DataFrame, buckets: int) -> DataFrame:
    """Deal packed blobs out by bucket."""
    return df.repartition(buckets, "bucket")


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins, in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal disjoint ones; touching intervals join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return starts[at], reach[np.r_[at[1:] - 1, len(starts) - 1]]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
