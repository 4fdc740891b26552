"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes over word shingles. Fingerprints that differ in at most ``tau`` bits are linked, and links close to
components. Candidates come from masks: the 64 bits are grouped into partitions of correlated bits (correlations are counted over all
distinct fingerprints), and a dynamic program spreads ``tau + 1`` units over the partitions. A partition with u units has threshold
u - 1: if two fingerprints differ in at most tau bits, in some partition they differ in at most u - 1, so they agree on that partition
without some u - 1 of its bits, which is one mask. Costs are the keys written and the estimated number of candidate pairs, taken
from a bounded sample; they steer the work, never the result. Several numbers of partitions are tried and the cheapest plan is taken.

Every distinct fingerprint meets others by (mask, masked bits). A bucket of at most ``bucket`` fingerprints is verified in one place and
gives a spanning forest, never all its pairs. A larger one is split again: its members agree on the mask, so the pigeonhole applies to the
bits left, with a longer mask each; this ends, as fingerprints that agree on 64 - tau bits are few. No bucket is cut and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, checkpointed, document_columns, field, fresh, offsets_of
from verseline.llm.components import components

BITS = 64
#: Bits in which linked fingerprints may differ if nothing else is said.
WORD_TAU = 4


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles; 0 for a text without words."""
    return int(_simhash(text.encode("utf-8", "replace").lower().split(), shingle, (42,))[0])


def _simhash(words: list[bytes], shingle: int, seeds: tuple[int, ...]) -> np.ndarray:
    """64 bits per seed."""
    if not words:
        return np.zeros(len(seeds), dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = offsets_of([len(w) + 1 for w in words])
    lo, hi = starts[:n].tolist(), (starts[min(shingle, len(words)) :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros((len(seeds), BITS), dtype=np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seeds[0]) for a, b in zip(lo[i : i + (1 << 16)], hi[i : i + (1 << 16)])], dtype="<u8")
        for k, seed in enumerate(seeds):
            counts[k] += np.unpackbits((h if not k else _again(h, seed)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def _again(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of hashes."""
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; null texts count as empty."""
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in p.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(fps)], ["doc_id", "fp"])

    return document_columns(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together: 64 x 64 counters per task, summed by Spark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for p in parts:
            b = _bits(p.column(0).to_numpy()).astype(np.float32)
            n, total = n + len(b), total + b.T @ b
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], ["cell", "n"])

    sums = {r["cell"]: r["n"] for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return sums.get(BITS * BITS, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width that keep correlated bits together, grown one bit at a time."""
    p = np.diag(together) / max(1, n)
    cov = together / max(1, n) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        sub = corr[np.ix_(left, left)]
        own = [left[int(sub.sum(axis=1).argmax())]]
        while len(own) < width:
            rest = [b for b in left if b not in own]
            own.append(max(rest, key=lambda b: (corr[b, own].sum(), -b)))
        left = [b for b in left if b not in own]
        out.append(sorted(own))
    return out


def allocate(widths: list[int], near: list[list[float]], n: int, tau: int, key_cost: float = 40.0) -> tuple[float, list[int]]:
    """Units per partition (threshold + 1) with the least cost; ``near[i][t]``: share of pairs within t bits in partition i."""
    pairs = n * (n - 1) / 2
    best = {0: (0.0, [])}
    for i, w in enumerate(widths):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, plan) in best.items():
            for u in range(tau + 2 - used):
                if u > w:
                    break
                keys = 0 if u == 0 else len(list(combinations(range(w), u - 1)))
                c = cost + (0 if u == 0 else key_cost * n * keys + pairs * near[i][u - 1] * max(1, keys / max(1, w)))
                if used + u not in nxt or c < nxt[used + u][0]:
                    nxt[used + u] = (c, [*plan, u])
        best = nxt
    return best[tau + 1]


def plan(fps: DataFrame, tau: int, sample: int = 2048, key_cost: float = 40.0) -> list[int]:
    """Masks for these distinct fingerprints; ``key_cost``: what a written key costs in compared pairs."""
    n, together = bit_counts(fps)
    taken = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp")).limit(sample).collect()], dtype=np.int64)
    bits = _bits(taken).astype(np.int16) if len(taken) else np.zeros((0, BITS), np.int16)
    choices = []
    for parts in range(max(1, (tau + 2) // 2), min(BITS, 2 * tau + 3)):
        groups = group_bits(n, together, parts)
        near = []
        for g in groups:
            b = bits[:, g].astype(np.float32)
            ones = b.sum(axis=1)
            d = (ones[:, None] + ones[None, :] - 2 * b @ b.T)[np.triu_indices(len(b), 1)]
            near.append([(float((d <= t + 0.5).sum()) + 1) / (len(d) + 1) for t in range(tau + 1)])
        choices.append((*allocate([len(g) for g in groups], near, n, tau, key_cost), groups))
    cost, units, groups = min(choices, key=lambda c: c[0])
    return list(dict.fromkeys(m for g, u in zip(groups, units) if u for m in _masks(0, g, u)))


def _masks(held: int, bits: list[int], units: int) -> list[int]:
    """Masks that keep ``held`` and a partition without each choice of ``units - 1`` of its bits."""
    every = held | sum(1 << b for b in bits)
    return [every & ~sum(1 << b for b in c) for c in combinations(bits, units - 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, tau: int) -> list[int]:
    """The pigeonhole on the bits outside a mask: tau + 1 parts, one of which agrees."""
    mask &= (1 << 64) - 1
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: tau + 1]) for k in range(tau + 1)]


def _forest(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(fps) - 1):
        for j in np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= tau)[0].tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                root[b] = a
                out.append((i, i + 1 + j))
    return out


def links(nodes: DataFrame, tau: int = WORD_TAU, bucket: int = 2000, key_cost: float = 40.0) -> DataFrame:
    """(a, b) edges between nodes (node, fp) whose components are those of all links.

    Nodes of one fingerprint are linked to the smallest of them, which alone goes on. A bucket whose mask leaves at most ``tau`` bits free
    holds links only and is closed the same way, so splitting always ends.
    """
    spark = nodes.sparkSession
    same = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    found = nodes.join(same, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    nodes = checkpointed(same.select(F.col("first").alias("node"), "fp"))
    masks = plan(nodes.select("fp"), tau, key_cost=key_cost)
    cols = ["node", "fp"]

    def keyed(rows: DataFrame, choose) -> DataFrame:
        return rows.select(*cols, F.explode(choose).alias("mask")).withColumn("held", F.col("fp").bitwiseAND(F.col("mask")))

    def literal(masks: list[int]):
        return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            a, b = [], []
            for v in p.column(0):
                own = sorted(v.as_py(), key=lambda r: r["node"])
                for i, j in _forest(np.array([r["fp"] for r in own], dtype=np.int64).view(np.uint64), tau):
                    a.append(own[i]["node"])
                    b.append(own[j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = keyed(nodes, literal(masks))
    while True:
        sizes = rows.groupBy("mask", "held").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
        met = rows.join(sizes, ["mask", "held"])
        near = F.bit_count("mask") >= BITS - tau
        done = (F.col("n") <= bucket) | near
        small = met.where(done & ~near).groupBy("mask", "held").agg(F.collect_list(F.struct(*cols)).alias("own")).select("own").mapInArrow(verify, "a long, b long")
        found = found.unionByName(small).unionByName(met.where(near & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b")))
        hot = [r["mask"] for r in sizes.where(~done).select("mask").distinct().collect()]  # as many as there are masks at most
        if not hot:
            return found
        finer = spark.createDataFrame([(m, [_signed(x) for x in _finer(m, tau)]) for m in hot], "mask long, finer array<long>")
        wide = met.where(~done).join(finer, "mask").select(*cols, "finer")
        rows = checkpointed(keyed(wide, F.col("finer")).dropDuplicates(["node", "mask"]))


def near_components(rows: DataFrame, tau: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest doc_id reachable over links of at most ``tau`` bits.

    Rows with equal fingerprints are linked, so the work is done on distinct fingerprints. A component whose ids are all null has a null
    component_id; otherwise null ids are passed over. Repeated rows stay.
    """
    rows = checkpointed(rows)
    fps = checkpointed(rows.select("fp").distinct())
    stars = components(links(fps.withColumn("node", F.col("fp")), tau)).withColumnRenamed("node", "fp")
    labelled = rows.join(stars, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(first, "component").select("doc_id", "fp", "component_id")


#: Near-duplicate documents: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 at least. Fingerprints of such sets differ in
#: 9.8 of 64 bits on average, too many for the pigeonhole alone, so candidates are also those that share all minima of one band: a pair at 0.8 shares none of
#: the 24 with a probability of 7e-5, and fewer than 73 of the 120 minima with one of 1e-6, whatever the edit's shape.
ROWS, BANDS, AGREE = 5, 24, 73
_DRAWN = np.random.default_rng(20_241).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = offsets_of([len(w) + 1 for w in words])
    lo, hi = starts[:n].tolist(), (starts[min(shingle, len(words)) :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(lo, hi)], dtype="<u8"))


def _minima(h: np.ndarray) -> np.ndarray:
    out = np.full(ROWS * BANDS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(h), 4096):
        v = (h[None, i : i + 4096] ^ _DRAWN[0][:, None]) * _DRAWN[1][:, None]
        out = np.minimum(out, (v ^ (v >> np.uint64(32))).min(axis=1))
    return out


def _bands(m: np.ndarray) -> np.ndarray:
    """One key per band, from its number and its minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in m.reshape(BANDS, ROWS).T:
        out = _again(out ^ column, 3)
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 at least, of sorted distinct hashes."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (len(x) + len(y) - shared)


def _close(own: list[dict]) -> Iterator[tuple[int, int]]:
    """Links (a, b) between members of different components that join all that belong together, at most one less than members.

    Every pair of components is settled: a pair of texts whose minima agree often enough is verified exactly unless found links join it already.
    """
    own = sorted(own, key=lambda r: r["node"])
    nodes, label = np.array([r["node"] for r in own], dtype=np.int64), np.unique([r["component"] for r in own], return_inverse=True)[1]
    sig = np.array([np.frombuffer(r["sig"], dtype=np.uint8) for r in own])
    sets = [np.frombuffer(r["hashes"], dtype="<u8") for r in own]
    size, starts = np.array([len(x) for x in sets]), offsets_of([len(x) for x in sets])
    # shingles as small numbers, so that one text's set is a row of flags
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    flags = np.zeros(len(code), dtype=np.uint8)
    step = max(1, (8 << 20) // sig.size)
    for lo in range(0, len(own), step):
        agree = (sig[lo : lo + step, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int16)
        for i in range(lo, min(lo + step, len(own))):
            j = np.nonzero((agree[i - lo] >= AGREE) & (label != label[i]))[0]
            j = j[(j > i) & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))]
            if not len(j):
                continue
            mine = code[starts[i] : starts[i + 1]]
            flags[mine] = 1
            for part in np.array_split(j, -(-int(size[j].sum()) // (1 << 22))):
                at = np.repeat(starts[part] - offsets_of(size[part])[:-1], size[part]) + np.arange(int(size[part].sum()))
                shared = np.add.reduceat(flags[code[at]], offsets_of(size[part])[:-1], dtype=np.int64)
                for k in part[5 * shared >= 4 * (size[i] + size[part] - shared)].tolist():
                    if label[k] != label[i]:
                        label[label == label[k]] = label[i]
                        yield int(nodes[i]), int(nodes[k])
            flags[mine] = 0


def _cells(members: DataFrame, bucket: int, most: int) -> DataFrame:
    """(own) groups in which all pairs of one cluster and different components meet; a group has about ``bucket`` members and ``most`` bytes of
    shingles at most.

    ``members``: node, cluster, component, sig, hashes. Larger clusters are cut in pieces: the members of their largest component need no pairs
    among themselves, so a piece of them meets every piece of the others only.
    """
    weight = F.greatest(F.lit(1 / bucket), F.octet_length("hashes") / most)
    by = members.groupBy("cluster", "component").agg(F.sum(weight).alias("k"))
    sizes = by.groupBy("cluster").agg(F.sum("k").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("k", "component")).alias("top")).where("kinds > 1")
    # piece counts by halves, so that two pieces make a group
    rest, tops = F.ceil(2 * (F.col("n") - F.col("top.k"))).cast("int"), F.ceil(2 * F.col("top.k")).cast("int")
    sizes = checkpointed(sizes.select("cluster", F.col("top.component").alias("top"), (F.col("n") > 1).alias("cut"), F.greatest(F.lit(1), rest).alias("rest"), F.greatest(F.lit(1), tops).alias("tops")))
    rows = members.join(sizes, "cluster")
    piece = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    name = lambda i, kind, k: F.concat(i.cast("string"), F.lit(kind), k.cast("string"))
    i, k = piece(F.col("rest")), piece(F.col("tops"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest = F.concat(F.transform(upto("rest"), lambda j: name(F.least(i, j), "r", F.greatest(i, j))), F.transform(upto("tops"), lambda j: name(i, "x", j)))
    cell = F.when(~F.col("cut"), F.array(F.lit(""))).when(F.col("component") == F.col("top"), F.transform(upto("rest"), lambda j: name(j, "x", k))).otherwise(rest)
    return rows.select("cluster", "node", "sig", "hashes", "component", F.explode(cell).alias("cell")).groupBy("cluster", "cell").agg(F.collect_list(F.struct("node", "sig", "hashes", "component")).alias("own")).select("own")


def near_documents(docs: DataFrame, shingle: int = 5, bucket: int = 4000, most: int = 32 << 20, tau: int = 2) -> DataFrame:
    """(key, key2, component): rows of ``docs`` by the hashes of ``document_keys`` and the component of near-duplicate texts.

    Texts with equal words are one node. Candidates are the components of operator 4 (SimHash fingerprints linked at ``tau`` or fewer bits) and, for
    the near copies whose fingerprints differ in more, texts that share the minima of a band. Every link is verified by the exact Jaccard similarity
    of the shingle sets (64-bit hashes). Every node is first compared with the best of the smallest nodes of its buckets, which links most of a group
    of near copies. Then nodes that hang together over bands are a cluster; its members travel once with their shingle sets, and the task
    that gets them (or two pieces of them) settles all pairs of different components there and writes a spanning forest, never candidate pairs.
    The work, not what is written, grows with the square of a cluster whose texts are no links of each other.
    """
    batches(docs.sparkSession)

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            nodes, fps, bands, sigs = [], [], [], []
            for t in p.column(2):
                words = t.as_py().encode("utf-8", "replace").lower().split()
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                fps.append(int(_simhash(words, 3, (42,))[0]))
                m = _minima(shingle_set(words, shingle)) if len(words) > shingle else None  # shorter ones have one shingle: no partner
                bands.append([] if m is None else _bands(m).view(np.int64))
                sigs.append(None if m is None else (m & np.uint64(255)).astype(np.uint8).tobytes())
            node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), node, fp, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["key", "key2", "node", "fp", "bands", "sig"])

    def sets_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            made = [shingle_set(t.as_py().encode("utf-8", "replace").lower().split(), shingle).tobytes() for t in p.column(1)]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(made, pa.binary())], ["node", "hashes"])

    def hubs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            a, b, sa, sb = (p.column(i).to_pylist() for i in range(4))
            agree = [int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], ["a", "b", "agree"])

    def close(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for v in p.column(0):
                got = list(_close(v.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            yes = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(p.column(2), p.column(3))]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    texts = document_keys(docs)
    rows = checkpointed(texts.select("key", "key2", "text").mapInArrow(sketch, "key long, key2 long, node long, fp long, bands array<long>, sig binary"))
    nodes = rows.dropDuplicates(["node"])
    # a component of operator 4 is a meeting place like a band; what is no link is sorted out by the exact check
    near = near_components(nodes.where("sig is not null").select(F.col("node").alias("doc_id"), "fp"), tau)
    near = near.select(F.col("doc_id").alias("node"), F.xxhash64(F.lit("operator 4"), "component_id").alias("band"))
    keyed = nodes.select("node", F.explode("bands").alias("band")).unionByName(near)
    shared = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    met = checkpointed(keyed.join(shared, "band").join(nodes.select("node", "sig"), "node"))
    needed = met.select("node").distinct().join(nodes.select("node", "key", "key2"), "node")
    wanted = texts.select("key", "key2", "text").join(needed, ["key", "key2"]).dropDuplicates(["node"]).select("node", "text")
    sets = checkpointed(wanted.mapInArrow(sets_of, "node long, hashes binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        return checkpointed(pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"))

    pairs = met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "sig").distinct()
    hub_sigs = nodes.select(F.col("node").alias("a"), F.col("sig").alias("hub_sig")).join(met.select(F.col("hub").alias("a")).distinct(), "a", "left_semi")
    pairs = pairs.join(hub_sigs, "a").select("a", "b", "sig", "hub_sig").mapInArrow(hubs, "a long, b long, agree int").where(F.col("agree") >= AGREE)
    tried = checkpointed(pairs.groupBy("b").agg(F.max(F.struct("agree", "a"))["a"].alias("a")).select("a", "b"))
    edges = verified(tried)
    labels = components(edges)
    clusters = components(met.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")
    members = clusters.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a cluster of one component is settled: its sets do not travel
    open_ = checkpointed(members.groupBy("cluster").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("cluster"))
    members = checkpointed(members.join(open_, "cluster").join(nodes.select("node", "sig"), "node").join(sets, "node"))
    edges = edges.unionByName(checkpointed(_cells(members, bucket, most).mapInArrow(close, "a long, b long")))
    stars = components(edges)
    return rows.join(stars, "node", "left").select("key", "key2", F.coalesce("component", "node").alias("component"))


def document_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, key2): two hashes of id and text, never null, that tell rows apart unless they are equal."""
    return document_columns(docs).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("key2", F.xxhash64("text", "doc_id", F.lit(1)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate group, with all columns: the one of the smallest doc_id (nulls last), of equal ones any."""
    near = near_documents(docs, **options)
    own = document_keys(docs).select("doc_id", "key", "key2").distinct()
    first = near.join(own, ["key", "key2"]).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "key2")).alias("m"))
    key, key2, id_, text = (fresh(docs, c) for c in ("key", "key2", "id", "text"))
    chosen = first.select(F.col("m.key").alias(key), F.col("m.key2").alias(key2))
    tagged = docs.withColumn(id_, field(docs, "doc_id").cast("long")).withColumn(text, F.coalesce(field(docs, "text").cast("string"), F.lit("")))
    tagged = tagged.withColumn(key, F.xxhash64(id_, text)).withColumn(key2, F.xxhash64(text, id_, F.lit(1))).drop(id_, text)
    return tagged.join(chosen, [key, key2], "left_semi").dropDuplicates([key, key2]).drop(key, key2)
