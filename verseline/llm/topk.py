"""Exact top-k inner-product search with a ball tree per shard.

Vectors are quantised to integers, ``floor(scale * x)``, so that scores are exact. The rows are dealt evenly to shards of bounded size; each
shard builds a ball tree (a centre and a radius per node) and answers a block of queries by branch and bound: nodes come off a heap in order
of their upper bound ``q.c + |q| r`` and the search of a query ends when the bound falls below its kth score. That kth score is shared: a
first pass reads only the most promising leaf of every shard, the kth best of those scores over all shards is a lower bound of the final
one, and the second pass prunes by it everywhere. Ties go to the smaller id, so a node whose bound equals the kth score is still read.

The query set is worked off in blocks of ``block`` vectors, the only rows that pass through the driver. Defined results: vectors that are
null, or hold null or non-finite components, and rows with a null id take no part; a query meets only vectors of its own length, and never
rows of its own id; equal query rows count once; fewer than k candidates give them all; components of 2**31 or more after scaling raise an
error, as scores of 64 bits could not hold them. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.common import batches, field, shared_folder

LEAF = 64


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = field(vectors, "embedding").cast("array<double>")
    rows = vectors.select(field(vectors, "vec_id").cast("long").alias("vec_id"), v.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


class BallTree:
    """Nodes in arrays: centre, radius, children (-1: leaf) and the range of rows in ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.kids, self.span = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me, own = len(self.centre), self.order[lo:hi]
            if parent >= 0:
                self.kids[parent][side] = me
            rows = x[own]
            c = rows.mean(axis=0)
            away = np.sqrt(((rows - c) ** 2).sum(axis=1))
            self.centre.append(c)
            self.radius.append(float(away.max(initial=0.0)))
            self.kids.append([-1, -1])
            self.span.append((lo, hi))
            if hi - lo > LEAF and self.radius[-1] > 0:
                far = rows[int(away.argmax())]
                line = far - rows[int(((rows - far) ** 2).sum(axis=1).argmax())]
                mid = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(rows @ line, mid)]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.x = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product per query and node, with room for rounding."""
        norm = np.sqrt((q * q).sum(axis=1))
        b = q @ self.centre.T + norm[:, None] * self.radius[None, :]
        return b + 1e-9 * (np.abs(b) + norm[:, None] * (self.radius + np.abs(self.centre).sum(axis=1))[None, :]) + 1e-6

    def best(self, q, bounds, ids, own: int, k: int, floor: float, leaves: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, -id) that reach ``floor``, or those of the first ``leaves`` leaves only."""
        heap, found, kth = [(-bounds[0], 0)], [], floor
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            lo, hi = self.span[node]
            s = self.x[lo:hi] @ q
            for i in np.nonzero(s >= kth)[0].tolist():
                name = int(ids[self.order[lo + i]])
                if name != own:
                    entry = (int(s[i]), -name)
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
            if len(found) == k:
                kth = max(kth, found[0][0])
            if leaves is not None:
                leaves -= 1
                if leaves <= 0:
                    break
        return found


def _exact(x: np.ndarray) -> np.ndarray:
    """As floats when every inner product stays exact in them, else as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most >= 1 << 31:
        raise ValueError("a scaled component reaches 2**31")
    return x.astype(np.float64)


def _search(block: list[tuple[int, np.ndarray]], k: int, floors: np.ndarray, leaves: int | None, shard_rows: int):
    """Function for mapInArrow: shard rows (vec_id, v) -> (query, vec_id, score)."""
    sizes = sorted({len(v) for _, v in block})
    groups = {n: [i for i, (_, v) in enumerate(block) if len(v) == n] for n in sizes}
    stacked = {n: np.array([block[i][1] for i in g], dtype=np.int64).reshape(len(g), n) for n, g in groups.items()}
    names = [i for i, _ in block]

    def shard(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        n = x.shape[1]
        q = stacked[n]
        if n * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) >= 1 << 53:
            yield from _plain(ids, x, q)
            return
        tree, qf = BallTree(_exact(x)), _exact(q)
        bounds = tree.bounds(qf)
        for row, i in enumerate(groups[n]):
            for s, name in tree.best(qf[row], bounds[row], ids, names[i], k, floors[i], leaves):
                yield i, -name, s

    def _plain(ids, x, q):
        """Components too large for exact floats: whole numbers of any size."""
        for row, i in enumerate(groups[x.shape[1]]):
            s = x.astype(object) @ q[row].astype(object) if x.shape[1] else np.zeros(len(x), dtype=object)
            yield from ((i, -m, v) for v, m in heapq.nlargest(k, ((int(a), -int(b)) for a, b in zip(s, ids) if int(b) != names[i])))

    def emit(ids: list, rows: list) -> Iterator[pa.RecordBatch]:
        for n in sizes:
            own = [j for j, v in enumerate(rows) if len(v) == n]
            if own:
                got = list(shard(np.array([ids[j] for j in own]), np.array([rows[j] for j in own], dtype=np.int64).reshape(len(own), n)))
                if got:
                    a, b, c = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query", "vec_id", "score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for p in parts:
            ids += p.column(0).to_pylist()
            v = p.column(1)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            rows += [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]
            while len(ids) >= shard_rows:
                yield from emit(ids[:shard_rows], rows[:shard_rows])
                ids, rows = ids[shard_rows:], rows[shard_rows:]
        if ids:
            yield from emit(ids, rows)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, shard_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors``; both as made by ``quantised``."""
    spark = vectors.sparkSession
    batches(spark)
    n = vectors.count()
    shards = vectors.repartition(max(1, -(-n // shard_rows)))
    schema = "query int, vec_id long, score long"

    def answer(rows: list) -> DataFrame:
        own = [(r["vec_id"], np.array(r["v"], dtype=np.int64)) for r in rows]
        floors = np.full(len(own), -np.inf)
        first = shards.mapInArrow(_search(own, k, floors, 1, shard_rows), schema)
        top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        for r in first.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select("query", "score").collect():
            floors[r["query"]] = r["score"]
        found = shards.mapInArrow(_search(own, k, floors, None, shard_rows), schema).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(own)], "query int, query_id long")
        return found.join(names, "query").select("query_id", "rank", "vec_id", "score")

    results, held, folder = [], [], None
    for r in queries.distinct().toLocalIterator():
        held.append(r)
        if len(held) == block:
            folder = folder or shared_folder(spark)
            answer(held).write.mode("append").parquet(folder)
            held = []
    if held or folder is None:
        results.append(answer(held) if held else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"))
    if folder is not None:
        results.append(spark.read.parquet(folder))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])
