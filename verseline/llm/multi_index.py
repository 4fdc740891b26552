"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length one and cut in two halves, each quantised by its own k-means codebook; a pair of centroids is a cell of the
index. A query walks the pairs by the sum of its squared distances to both centroids, with a heap, until the cells read hold enough entries,
and the entries of these cells are reranked by the exact cosine of the original vectors in double precision.

The codebooks are fitted on ``sample`` rows (those of least hash; the bound does not grow with the data), every row is indexed. How many
entries are enough is measured, not guessed: for ``probes`` of the queries (least hash) one pass over all rows finds the true neighbours, and
the walk goes as far as holds the share ``recall`` of them. So clustered data are read sparsely and data without structure widely, with the
same rule at every size.

Entries of one vector (copies) are reduced to their k + 1 least ids before anything is shuffled by content: no other of them can be among the
k results of any query. A cell's rows, and the queries that visit it, are cut into blocks of bounded size that meet pairwise, so a cell may
hold any share of the rows. What is shared with all tasks are the two codebooks and the number of entries per cell, ``centroids`` squared at most.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part; a query meets
vectors of its own length only and never rows of its own id; rows of one id with different vectors are entries, and queries, of their own, equal
rows count once; ties go to the smaller id; with fewer than k candidates all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.common import batches, checkpointed, field

RESULT = "query_id long, query_key long, vec_id long, score double"


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    v = field(table, "embedding").cast("array<double>")
    rows = table.select(field(table, "vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda c: c != 0)).distinct()


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, so that no square overflows or vanishes and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = _tame(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact measure of pairs of rows; every pair is summed in the same order, whatever stands beside it."""
    a, b = _tame(a), _tame(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Codebook:
    """k-means centroids of one half of the vectors."""

    def __init__(self, x: np.ndarray, k: int, rounds: int = 12):
        x = np.unique(x, axis=0)
        k = min(k, len(x))
        rng = np.random.default_rng(0)
        c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
        for _ in range(rounds):
            own = self._nearest(x, c)
            size = np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            full = np.nonzero(size)[0]
            if x.shape[1]:
                sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[full])[:-1]]), axis=0)
                c[full] = sums / size[full, None]
        self.c = c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmin((c * c).sum(axis=1) - 2 * p @ c.T, axis=1) for p in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, dtype=np.int64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.c)

    def distances(self, q: np.ndarray) -> np.ndarray:
        return ((self.c - q) ** 2).sum(axis=1)


class MultiIndex:
    """Two codebooks, and the number of entries of every cell."""

    def __init__(self, sample: np.ndarray, centroids: int):
        unit = _unit(sample)
        self.length, self.cut = sample.shape[1], sample.shape[1] // 2
        self.books = Codebook(unit[:, : self.cut], centroids), Codebook(unit[:, self.cut :], centroids)
        self.sizes = np.zeros((len(self.books[0].c), len(self.books[1].c)), dtype=np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = _unit(x)
        return self.books[0].nearest(unit[:, : self.cut]), self.books[1].nearest(unit[:, self.cut :])

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells by the sum of the distances to both centroids."""
        unit = _unit(q[None])[0]
        d, e = self.books[0].distances(unit[: self.cut]), self.books[1].distances(unit[self.cut :])
        left, right = np.argsort(d, kind="stable").tolist(), np.argsort(e, kind="stable").tolist()
        d, e = d.tolist(), e.tolist()
        # a row of pairs enters when the row before it has given its first pair
        heap = [(d[left[0]] + e[right[0]], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield left[i], right[j]
            if j + 1 < len(right):
                heapq.heappush(heap, (d[left[i]] + e[right[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(left):
                heapq.heappush(heap, (d[left[i + 1]] + e[right[0]], i + 1, 0))

    def visited(self, q: np.ndarray, enough: int) -> dict[int, list[int]]:
        """Cells read until they hold ``enough`` entries: left centroid -> right centroids."""
        held, out = 0, {}
        for i, j in self.walk(q):
            n = int(self.sizes[i, j])
            if n:
                out.setdefault(i, []).append(j)
                held += n
                if held >= enough:
                    break
        return out


def _assigned(index: MultiIndex):
    """For mapInArrow: (vec_id, v) -> (cell_i, cell_j, vec_id, v)."""

    def run(parts):
        for b in parts:
            if b.num_rows:
                i, j = index.cells(_matrix(b.column(1), index.length))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), b.column(0), b.column(1)], ["cell_i", "cell_j", "vec_id", "v"])

    return run


def _true_neighbours(queries: list, k: int, length: int):
    """For mapInArrow over assigned entries: the best k of each batch for a bounded set of queries -> (query, vec_id, cell_i, cell_j, score)."""
    ids = np.array([r["vec_id"] for r in queries])
    unit = _unit(np.array([r["v"] for r in queries], dtype=np.float64).reshape(len(queries), length))

    def run(parts):
        for b in parts:
            if not b.num_rows:
                continue
            own = b.column(2).to_numpy()
            s = unit @ _unit(_matrix(b.column(3), length)).T
            s[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, len(own))
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            q = np.repeat(np.arange(len(ids)), n)
            at = at.ravel()
            keep = s[q, at] > -np.inf
            q, at = q[keep], at[keep]
            cells = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(own[at], pa.int64()), pa.array(cells[0][at]), pa.array(cells[1][at]), pa.array(s[q, at])], ["query", "vec_id", "cell_i", "cell_j", "score"])

    return run


def _enough(index: MultiIndex, entries: DataFrame, queries: DataFrame, k: int, probes: int, recall: float) -> int:
    """Entries that a walk has to read to meet the share ``recall`` of the true neighbours of some queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(probes).collect()
    if not some:
        return k + 1
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = entries.mapInArrow(_true_neighbours(some, k, index.length), "query int, vec_id long, cell_i int, cell_j int, score double")
    reach: list[int] = []
    wanted: dict[int, list] = {}
    for r in found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect():
        wanted.setdefault(r["query"], []).append((r["cell_i"], r["cell_j"]))
    for n, cells in wanted.items():
        held, left = 0, list(cells)
        for i, j in index.walk(np.array(some[n]["v"])):
            held += int(index.sizes[i, j])
            while (i, j) in left:
                left.remove((i, j))
                reach.append(held)
            if not left:
                break
    reach.sort()
    return max(k + 1, reach[min(len(reach) - 1, math.ceil(recall * len(reach)))]) if reach else k + 1


def _probed(index: MultiIndex, enough: int):
    """For mapInArrow over queries: (vec_id, v) -> (cell_i, query_id, cells, v), a row for every left centroid that the walk meets."""

    def run(parts):
        for b in parts:
            x = _matrix(b.column(1), index.length) if b.num_rows else []
            for lo in range(0, len(x), 64):
                rows = [(i, k, js) for k in range(lo, min(lo + 64, len(x))) for i, js in index.visited(x[k], enough).items()]
                i, k, js = zip(*rows)
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), b.column(0).take(k), pa.array(js, pa.list_(pa.int32())), b.column(1).take(k)], ["cell_i", "query_id", "cells", "v"])

    return run


def _reranked(k: int, length: int):
    """For cogroup.applyInArrow: a block of entries of one left centroid and a block of queries that visit it -> their best k."""

    def run(entries: pa.Table, probes: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if entries.num_rows and probes.num_rows:
            entries = entries.sort_by([("cell_j", "ascending"), ("vec_id", "ascending")])
            ids, x = entries["vec_id"].to_numpy(), _matrix(entries["v"], length)
            of, names, keys = _matrix(probes["v"], length), probes["query_id"].to_numpy(), probes["query_key"].to_numpy()
            unit, near = _unit(x), _unit(of)
            cells, first = np.unique(entries["cell_j"].to_numpy(), return_index=True)
            until = np.append(first[1:], len(ids))
            lists = probes["cells"].combine_chunks()
            visits = np.repeat(np.arange(len(of)), np.diff(lists.offsets.to_numpy()))
            each = lists.flatten().to_numpy()
            s = np.full((len(of), len(ids)), -np.inf)
            for c, a, z in zip(cells, first, until):
                q = visits[each == c]
                if len(q):
                    s[q, a:z] = near[q] @ unit[a:z].T
            s[names[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            # rounding of the products must not decide: all within it are measured exactly
            q, at = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
            for lo in range(0, len(q), 1 << 14):
                p, e = q[lo : lo + (1 << 14)], at[lo : lo + (1 << 14)]
                score = cosine(of[p], x[e])
                order = np.lexsort((ids[e], -score, p))
                p, e, score = p[order], e[order], score[order]
                start = np.searchsorted(p, p)
                best = np.arange(len(p)) - start < k
                for held, part in zip(out, (names[p][best], keys[p][best], ids[e][best], score[best])):
                    held.append(part)
        arrays = [np.concatenate(h) if h else [] for h in out]
        return pa.table([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, per: int, name: str) -> DataFrame:
    """(cell_i, ``name``): the number of blocks that the rows of a left centroid are cut in."""
    return rows.groupBy("cell_i").agg(F.ceil(F.count("*") / per).cast("int").alias(name))


def _of_length(entries: DataFrame, queries: DataFrame, length: int, n: int, k: int, sample: int, centroids: int, probes: int, recall: float, entry_block: int, query_block: int) -> DataFrame:
    rows = entries.where(F.size("v") == length)
    asked = queries.where(F.size("v") == length)
    x = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["v"]
    index = MultiIndex(_matrix(x, length), max(2, min(centroids, 1 << round(math.log2(math.sqrt(n) / 3 + 1)))))
    placed = checkpointed(rows.mapInArrow(_assigned(index), "cell_i int, cell_j int, vec_id long, v array<double>"))
    for r in placed.groupBy("cell_i", "cell_j").count().collect():
        index.sizes[r["cell_i"], r["cell_j"]] = r["count"]
    enough = _enough(index, placed, asked, k, probes, recall)
    visits = checkpointed(asked.mapInArrow(_probed(index, enough), "cell_i int, query_id long, cells array<int>, v array<double>").withColumn("query_key", F.xxhash64("v")))
    # one row per left centroid: as small as a codebook
    split = _blocks(placed, entry_block, "entry_blocks").join(_blocks(visits, query_block, "query_blocks"), "cell_i").collect()
    sizes = placed.sparkSession.createDataFrame(split, "cell_i int, entry_blocks int, query_blocks int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = placed.join(F.broadcast(sizes), "cell_i").withColumn("eb", F.pmod(F.xxhash64("vec_id", "v"), F.col("entry_blocks")).cast("int")).withColumn("qb", every("query_blocks")).drop("entry_blocks", "query_blocks")
    right = visits.join(F.broadcast(sizes), "cell_i").withColumn("qb", F.pmod(F.xxhash64("query_id", "v"), F.col("query_blocks")).cast("int")).withColumn("eb", every("entry_blocks")).drop("entry_blocks", "query_blocks")
    keys = ["cell_i", "eb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_reranked(k, length), RESULT)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.97, sample: int = 20_000, centroids: int = 1024, probes: int = 256, entry_block: int = 8192, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` about its k nearest rows of ``vectors``; both as made by ``vectors_of``.

    ``recall``: the share of true neighbours aimed at; ``centroids``: the most centroids of a half (their number grows with the square root
    of the rows up to it); ``sample``, ``probes``: bounds of what fits the codebooks and the length of the walks.
    """
    spark = vectors.sparkSession
    batches(spark)
    ids = Window.partitionBy("v").orderBy("vec_id")
    entries = checkpointed(vectors.withColumn("copy", F.row_number().over(ids)).where(F.col("copy") <= k + 1).drop("copy"))
    found = spark.createDataFrame([], RESULT)
    for r in entries.groupBy(F.size("v").alias("length")).count().orderBy("length").collect():
        found = found.unionByName(_of_length(entries, queries, r["length"], r["count"], k, sample, centroids, probes, recall, entry_block, query_block))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
