"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are quantised to floor(256 * x). Queries and candidates are dealt out to a grid of cells of bounded size. In
a cell each dimension has a list of the candidates sorted by component; queries read all lists in step, score what
they meet for the first time by random access, and stop when no unread candidate can reach their k-th score: the
bound is the sum, over dimensions, of what each list's next entry could add. Cells' results merge to the global top k.

The lists are of the candidates' components along the cell's principal axes (an orthogonal turn keeps inner products),
so that on data with a few strong directions few entries decide. Lists and bounds are floats with a margin for
rounding; scores are exact integers. All queries of a cell that still read advance together: which candidates they
meet and what these score are matrix products over blocks of queries.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
an empty vector is one of zeros. Rows that share an id are candidates each on their own, and queries each with an
answer of its own; a row is only left out of its own answer. Shorter vectors are padded with zeros. Ties go to the
smaller id. Fewer than k candidates: all of them. Scores of any size rank exactly; one beyond 64 bits is returned as
the nearest 64-bit integer. Empty table: empty result. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkledger.llm import common as c

K = 5
#: Candidates and queries of a cell.
CELL = 8192
QUERIES = 2048
#: Queries that advance together, and the entries that they first read of each list.
BLOCK = 128
FIRST_DEPTH = 32
#: Above this share of pairs that a step meets, their scores come from one product instead of pair by pair.
DENSE = 0.02
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(flat: np.ndarray) -> np.ndarray:
    """Quantised components; Python integers where a float cannot be a 64-bit one."""
    scaled = np.floor(256 * flat)
    if len(flat) and np.abs(scaled).max() >= 2.0**62:
        return np.array([int(x) for x in scaled.tolist()], object)
    return scaled.astype(np.int64)


class SortedLists:
    """Candidates with one sorted list for each principal axis."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((own, ids))
        self.ids, self.own, self.vectors = ids[order], own[order], vectors[order]
        plain = self.vectors.astype(np.float64)
        self.size = np.abs(plain).max(initial=1.0)
        _, self.axes = np.linalg.eigh(plain.T @ plain / self.size**2)
        turned = plain / self.size @ self.axes
        self.up = np.argsort(turned, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(turned, self.up.T, axis=0).T
        self.longest = np.sqrt((turned * turned).sum(axis=1)).max(initial=0.0)
        self.read = self.pairs = 0

    def _kind(self, queries: np.ndarray):
        """The cheapest type of number in which every partial sum of a score is exact."""
        width = self.vectors.shape[1]
        if object in (queries.dtype, self.vectors.dtype):
            return object
        most = width * int(np.abs(queries).max(initial=0)) * int(np.abs(self.vectors).max(initial=0))
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, candidate's place, score) of each query's k best candidates other than itself, best first."""
        n, m = len(self.ids), len(queries)
        kind = self._kind(queries)
        exact, vectors = queries.astype(kind), self.vectors.astype(kind)
        turned = queries.astype(np.float64) @ self.axes
        falls = turned > 0  # read from the large end
        ends = np.concatenate([falls & (turned != 0), turned < 0], axis=1).astype(np.float32)
        margin = 1e-9 * self.size * self.longest * np.sqrt((turned * turned).sum(axis=1)) + 1e-3
        seen = self.own[None, :] == own[:, None]
        open_, out = np.arange(m), []
        best_at, best_score = np.zeros((m, 0), np.int64), np.zeros((m, 0), kind)
        depth, read = min(FIRST_DEPTH, n), 0
        while len(open_):
            new = ~seen[open_]
            if depth < n:
                met = np.zeros((2 * len(self.up), n), np.float32)
                rows = np.arange(len(self.up))[:, None]
                met[rows, self.up[:, n - depth :]] = 1
                met[len(self.up) + rows, self.up[:, :depth]] = 1
                new &= ends[open_] @ met > 0
            seen[open_] |= new
            self.read += int(new.sum())
            best_at, best_score = self._better(k, exact[open_], vectors, new, best_at, best_score)
            if depth < n:
                edge = np.where(falls[open_], self.sorted[:, n - depth], self.sorted[:, depth - 1])
                bound = self.size * (edge * turned[open_]).sum(axis=1) + margin[open_]
                done = best_at[:, -1] >= 0 if best_at.shape[1] == k else np.zeros(len(open_), bool)
                done &= best_score[:, -1].astype(np.float64) > bound if best_score.shape[1] else False
            else:
                done = np.ones(len(open_), bool)
            out.append((open_[done], best_at[done], best_score[done]))
            open_, best_at, best_score = open_[~done], best_at[~done], best_score[~done]
            read, depth = depth, min(n, depth * 4)
        self.pairs += m * n
        query, at, score = (np.concatenate(x) for x in zip(*[(np.repeat(q, a.shape[1]), a.ravel(), s.ravel()) for q, a, s in out]))
        real = at >= 0
        return query[real], at[real], score[real]

    def _better(self, k: int, queries: np.ndarray, vectors: np.ndarray, new: np.ndarray, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those held and those newly met; places are in the order of ids, -1 stands for none."""
        m, n = new.shape
        if queries.dtype != object and new.mean() > DENSE:  # most are met: score them in one product, then look only at those met
            met = queries @ vectors.T
            width = min(k, n)
            cut = np.partition(np.where(new, met, met.min() - 1), n - width, axis=1)[:, n - width]
            row, place = np.nonzero(new & (met >= cut[:, None]))
            value = met[row, place]
        else:
            row, place = np.nonzero(new)
            value = (queries[row] * vectors[place]).sum(axis=1)
        row = np.concatenate([np.repeat(np.arange(m), at.shape[1]), row])
        place, value = np.concatenate([at.ravel(), place]), np.concatenate([score.ravel(), value])
        row, place, value = row[place >= 0], place[place >= 0], value[place >= 0]
        order = np.lexsort((place, -value, row)) if value.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -value[i], place[i])), np.int64)
        row, place, value = row[order], place[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row] if len(row) else np.zeros(0, np.int64)
        keep = rank < k
        best_at, best_score = np.full((m, k), -1, np.int64), np.zeros((m, k), value.dtype)
        best_at[row[keep], rank[keep]], best_score[row[keep], rank[keep]] = place[keep], value[keep]
        return best_at, best_score


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = whole(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(rows), width), flat.dtype)
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


FOUND = "own long, query_id long, vec_id long, score decimal(38,0)"


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        from decimal import Decimal

        width = max([1, *(t["embedding"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for t in (queries, candidates))])
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3 + ([],)]
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(), candidates["own"].to_numpy(), _matrix(candidates["embedding"], width))
            own, ids, asked = queries["own"].to_numpy(), queries["vec_id"].to_numpy(), _matrix(queries["embedding"], width)
            for i in range(0, len(own), BLOCK):
                row, at, score = lists.top(own[i : i + BLOCK], asked[i : i + BLOCK], k)
                out.append((own[i : i + BLOCK][row], ids[i : i + BLOCK][row], lists.ids[at], [Decimal(int(x)) for x in score.tolist()]))
        columns = [pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)]
        return pa.table([*columns, pa.array([x for o in out for x in o[3]], pa.decimal128(38, 0))], names=["own", "query_id", "vec_id", "score"])

    return run


def fit_to_search(vectors: DataFrame) -> Column:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; ``vectors`` has vec_id and embedding."""
    spark = vectors.sparkSession
    rows = vectors.where(fit_to_search(vectors)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    rows = c.write_table(rows.select("*", F.monotonically_increasing_id().alias("own")), "topk-rows")
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("asks")).head()
    tasks = 4 * spark.sparkContext.defaultParallelism
    down = max(1, -(-m // queries))
    across = max(1, -(-n // cell), min(-(-n // 512), -(-tasks // down)))  # small inputs are cut finer, so that every core has cells
    slot, parts = F.xxhash64("own"), max(c.partitions(spark), min(across * down, 1 << 16))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select("own", "vec_id", "embedding", F.pmod(slot, F.lit(across)).alias("c"), every(down).alias("q")).repartition(parts, "q", "c")
    asked = rows.where("asks").select("own", "vec_id", "embedding", F.pmod(slot, F.lit(down)).alias("q"), every(across).alias("c")).repartition(parts, "q", "c")
    found = asked.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(_search(k), FOUND)
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    score = F.greatest(F.least("score", F.lit(MOST).cast("decimal(38,0)")), F.lit(LEAST).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
