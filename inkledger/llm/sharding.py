"""Sharding by histogram sort, under the law of near-equal bytes.

Documents are ordered by (hash of text, hash of doc_id), so equal texts lie together. The driver keeps, for each
splitter between two shards, a key interval that must hold it, and refines all of them at once: each round counts
the exact bytes below a few hundred candidate boundaries inside the open intervals, and narrows them, until the
interval's bytes are within ``TOLERANCE`` of a shard or one key is left. One rule places every splitter: at the nearest
edge of the group of equal texts that it falls in if that moves it by at most ``MOVE`` of a shard's bytes, else between
documents of the group. A shard so has its ideal bytes within two times ``MOVE`` plus ``TOLERANCE``, or one document.
Then rows are exchanged once.

Slots number the rows of a shard in key order, by offsets of key bins, so that no task holds a whole shard; bins that
a large group of equal texts fills are cut by the second key.

Defined cases: null text: no bytes, crc of nothing. A very long text is one row; a shard holds it whole. Rows equal in
doc_id and text stay together. Fewer rows than shards: some shards are empty. Empty table: empty result. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

SHARDS = 40
#: Shares of a shard's ideal bytes: when an interval is narrow enough, and how far a splitter moves to a group's edge.
TOLERANCE = 0.001
MOVE = 0.01
#: Bins of a shard have this many times the mean rows before the second key cuts them.
FULL = 4
PROBES = 512
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Interval:
    low: int
    high: int  # inclusive
    below: int  # bytes of smaller keys
    inside: int


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _refine(rows: DataFrame, key: str, spans: list[Interval]) -> dict[int, list[tuple[int, int, int]]]:
    """For each span (by its low key): (least key, greatest key, bytes) of each non-empty probe range, in order."""
    spans = sorted(spans, key=lambda s: s.low)
    lows, highs = F.array(*[_long(s.low) for s in spans]), F.array(*[_long(s.high) for s in spans])
    widths = F.array(*[F.lit(str(max(1, -(-(s.high - s.low + 1) // PROBES)))).cast("decimal(20,0)") for s in spans])
    at = F.size(F.filter(lows, lambda x: x <= F.col(key)))
    inside = rows.withColumn("at", at).where("at > 0").where(F.col(key) <= F.element_at(highs, F.col("at")))
    gap = F.col(key).cast("decimal(20,0)") - F.element_at(lows, F.col("at")).cast("decimal(20,0)")
    probe = F.floor(gap / F.element_at(widths, F.col("at"))).cast("int")
    found: dict[int, list[tuple[int, int, int]]] = {s.low: [] for s in spans}
    for r in inside.groupBy("at", probe.alias("probe")).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.sum("size").alias("n")).orderBy("at", "probe").collect():  # PROBES for each open splitter at most
        found[spans[r["at"] - 1].low].append((r.a, r.b, r.n))
    return found


def _search(rows: DataFrame, key: str, first: Interval, goals: list[float], close: float) -> dict[float, Interval]:
    """For each goal the interval of keys that holds it: narrow, or a single key."""
    at = {g: first for g in goals}
    while True:
        todo = {s.low: s for s in at.values() if s.low < s.high and s.inside > close}
        if not todo:
            return at
        found = _refine(rows, key, list(todo.values()))
        for g, s in at.items():
            if s.low in todo and todo[s.low] is s:
                below = s.below
                for a, b, n in found[s.low]:
                    if below + n > g or (a, b, n) == found[s.low][-1]:
                        at[g] = Interval(a, b, below, n)
                        break
                    below += n
        unique: dict[tuple[int, int], Interval] = {}
        at = {g: unique.setdefault((s.low, s.high), s) for g, s in at.items()}


def splitters(rows: DataFrame, shards: int = SHARDS) -> list[tuple[int, int]]:
    """The least (k1, k2) of shards 1, 2, ...; ``rows`` has k1, k2 and size."""
    low, high, total = rows.agg(F.min("k1"), F.max("k1"), F.sum("size")).head()
    if total is None:
        return []
    ideal = total / shards
    goals = [ideal * k for k in range(1, shards)]
    near = _search(rows, "k1", Interval(low, high, 0, total), goals, TOLERANCE * ideal)
    out: dict[float, tuple[int, int]] = {}
    large: dict[int, list[float]] = {}
    for g, s in near.items():
        if s.low == s.high and min(g - s.below, s.below + s.inside - g) > MOVE * ideal:
            large.setdefault(s.low, []).append(g)
        else:
            out[g] = _edge(g, s, lambda k: (k, LOWEST))
    for k1, inner in large.items():
        group = rows.where(F.col("k1") == _long(k1))
        s = near[inner[0]]
        a, b = group.agg(F.min("k2"), F.max("k2")).head()
        for g, t in _search(group, "k2", Interval(a, b, s.below, s.inside), inner, TOLERANCE * ideal).items():
            out[g] = _edge(g, t, lambda k, k1=k1: (k1, k)) if t.high < HIGHEST else (k1, t.low)
    return [out[g] for g in goals]


def _edge(goal: float, s: Interval, key) -> tuple[int, int]:
    after = s.below + s.inside
    return key(s.low) if goal - s.below <= after - goal or s.high == HIGHEST else key(s.high + 1)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col("doc_id").cast("long")).alias("k2"))
    rows = c.write_table(rows, "sharding-keys")
    cuts = sorted(splitters(rows, shards))
    edges = F.array(*[F.struct(_long(a).alias("a"), _long(b).alias("b")) for a, b in cuts]) if cuts else None
    shard = F.size(F.filter(edges, lambda e: (e["a"] < F.col("k1")) | ((e["a"] == F.col("k1")) & (e["b"] <= F.col("k2"))))) if cuts else F.lit(0)
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("top", F.shiftright("k1", 52))
    counts = rows.groupBy("shard", "top").agg(F.count(F.lit(1)).alias("n"))
    tops = c.write_table(counts, "sharding-bins")
    mean = tops.agg(F.avg("n")).head()[0] or 0.0
    tops = tops.select("shard", "top", (F.col("n") > FULL * mean).alias("full"))  # at most 4096 bins and a shard's edge
    rows = rows.join(F.broadcast(tops), ["shard", "top"])
    fine = F.when(F.col("full"), F.struct(F.col("k1").alias("a"), F.shiftright("k2", 52).alias("b")))
    rows = rows.withColumn("bin", F.struct("top", fine.alias("fine"))).drop("top", "full")
    bins = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("k1", "k2", "doc_id", "text_crc32")) - 1
    b = bins.select(F.col("shard").alias("shard_"), F.col("bin").alias("bin_"), "before")
    placed = rows.withColumn("inside", inside).join(b, F.expr("shard = shard_ and bin <=> bin_"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_of(key: tuple[int, int], cuts: list[tuple[int, int]]) -> int:
    """The shard of one key, for readers that look a document up."""
    return bisect_right(cuts, key)
