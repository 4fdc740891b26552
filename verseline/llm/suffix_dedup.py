"""Exact removal of repeated byte strings with the interval tree of a sparse enhanced suffix array.

A byte goes if it lies in a string of ``N`` bytes that also starts anywhere else. Suffixes are kept only at anchors: in every window of N
bytes the leftmost smallest hash of its K-byte strings. Equal windows have their anchors at equal places, so every repeat of N bytes meets
itself at an anchor and nothing is lost, while the array has about 1 % of the positions. An anchor's context is what a window through it can
reach: N - K bytes to the left and N to the right. It decides which windows repeat:

1. Anchors are counted by the hash of their K bytes, with the least and the greatest context hash. Alone: no window repeats. Several, all with one
   context (copies): all of it repeats. Both are settled by a map-side combined count, however large a group of copies is.
2. The rest are mixed. Distinct contexts are sorted as suffixes inside their K-byte bucket; a stack scan over the common-prefix array
   gives the interval tree. The members of an interval share its depth to the right; sorted by their reversed left sides they show how
   far they agree to the left. An interval whose members differ there is a maximal repeat; every member gets the longest left extension it
   shares with another, and if depth and extension reach N, that stretch repeats - for all occurrences, not for neighbours alone.
3. A bucket of more than ``bucket`` distinct contexts (the edges of a passage that very many documents share) is not gathered: its windows are
   counted by hash, map-side combined, which gives the same stretches.

Equality rests on two independent 64-bit hashes together; inside buckets bytes are compared. Defined results: a null text is empty, nothing removed;
texts under N bytes stay whole; rows that repeat an id are documents of their own, and equal rows are copies of each other; null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, document_columns, shared_folder

N, K = 200, 32
LEFT = N - K
PIECE = 1 << 16
_MIX = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 20) - 1)


def _kmer_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on (K is a power of two: built by doubling)."""
    h, size = _MIX[b], 1
    while size < K:
        a = h[:-size] * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(29)
        a += h[size:]
        h, size = a, size * 2
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and K-byte hashes of the anchors of one text."""
    places, hashes = [], []
    windows = len(b) - N + 1
    for lo in range(0, max(0, windows), PIECE):
        hi = min(windows, lo + PIECE)
        h = _kmer_hashes(b[lo : hi + N - 1])
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, N - K + 1
        while size * 2 <= width:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        low = np.minimum(low[: hi - lo], low[width - size : width - size + hi - lo])
        at = (low & _LOW).astype(np.int64)
        at = at[np.append(True, at[1:] != at[:-1])]
        if places and places[-1][-1] == at[0] + lo:
            at = at[1:]
        if len(at):
            places.append(at + lo)
            hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _contexts(data: bytes, at: list[int]) -> list[int]:
    digest, n = xxhash.xxh3_64_intdigest, len(data)
    return [digest(data[max(0, a - LEFT) : a + N], min(a, LEFT)) for a in at]


def _signed(v) -> pa.Array:
    return pa.array(np.array(v, dtype=np.uint64).view(np.int64))


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, key, text) -> (kmer, ctx, did, key, pos) of every anchor."""
    for p in parts:
        dids, keys = p.column(0).to_numpy(), p.column(1).to_numpy()
        own, cols = [], [[], [], []]
        for i, t in enumerate(p.column(2)):
            data = t.as_py().encode("utf-8", "replace")
            at, h = anchors(np.frombuffer(data, dtype=np.uint8))
            if len(at):
                own.append(np.full(len(at), i))
                for c, v in zip(cols, (h, np.array(_contexts(data, at.tolist()), dtype=np.uint64), at)):
                    c.append(v)
        if own:
            i, (h, c, at) = np.concatenate(own), [np.concatenate(x) for x in cols]
            yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), pa.array(dids[i]), pa.array(keys[i]), pa.array(at.astype(np.int32))], ["kmer", "ctx", "did", "key", "pos"])


def _fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, own: array of pos, kmer, ctx) -> (kmer, ctx, l, body): the bytes of chosen contexts, l of them left of the anchor."""
    for p in parts:
        rows = []
        for t, own in zip(p.column(0), p.column(1)):
            data = t.as_py().encode("utf-8", "replace")
            rows += [(r["kmer"], r["ctx"], min(r["pos"], LEFT), data[max(0, r["pos"] - LEFT) : r["pos"] + N]) for r in own.as_py()]
        if rows:
            k, c, n, body = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], ["kmer", "ctx", "l", "body"])


def _square(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal width, filled with zeros, and their own lengths."""
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width), np.array([len(r) for r in rows])


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows a and b."""
    differ = m[a] != m[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(size[a], size[b]))


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of depth ``least`` or more, innermost first; ``common[i]`` is shared by rows i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now, first = (common[i] if i < len(common) else 0), i - 1
        while stack[-1][0] > now:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i - 1
        if stack[-1][0] < now:
            stack.append((now, first))


def stretches(kmers: list[int], lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, left extension, depth) of every repeated stretch of N bytes or more; rows sorted by (kmer, right), lefts reversed."""
    right, right_n = _square(rights, N)
    left, left_n = _square(lefts, LEFT)
    at = np.arange(1, len(kmers))
    common = np.append(0, np.where(np.array(kmers[1:]) == np.array(kmers[:-1]), _common(right, right_n, at - 1, at), 0)) if len(kmers) > 1 else np.zeros(1, int)
    order = None
    pairs, out = [], []
    for depth, first, last in intervals(common.tolist(), K):
        if last == first + 1:
            pairs.append((depth, first, last))
            continue
        if order is None:
            order = np.empty(len(lefts), dtype=np.int64)
            order[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(lefts))
        own = first + np.argsort(order[first : last + 1])
        reach = _common(left, left_n, own[:-1], own[1:])
        if reach.max() + depth < N:
            continue
        best = np.maximum(np.append(0, reach), np.append(reach, 0))
        hit = best + depth >= N
        out.append((own[hit], best[hit], np.full(int(hit.sum()), depth)))
    if pairs:
        depth, a, b = np.array(pairs).T
        reach = _common(left, left_n, a, b)
        hit = reach + depth >= N
        out += [(a[hit], reach[hit], depth[hit]), (b[hit], reach[hit], depth[hit])]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kmer, ctx, l, body) sorted by bucket and suffix -> (kmer, ctx, code): stretches; a bucket is held until it is complete."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        own, reach, depth = stretches([r[0] for r in rows], [r[3][: r[2]][::-1] for r in rows], [r[3][r[2] :] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in own.tolist()], pa.int64()), pa.array([rows[i][1] for i in own.tolist()], pa.int64()), pa.array(reach * 256 + depth, pa.int64())], ["kmer", "ctx", "code"]
        )

    held: list[tuple] = []
    for p in parts:
        held += zip(*[p.column(c).to_pylist() for c in range(4)])
        if len(held) >= 5000:
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield settle(held[:cut])
                held = held[cut:]
    if held:
        yield settle(held)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, text, codes) -> the result rows."""
    for p in parts:
        n, gone, runs, sha, starts, ends = [], [], [], [], [], []
        for t, codes in zip(p.column(1), p.column(2)):
            data = t.as_py().encode("utf-8", "replace")
            lo, hi = removed(len(data), codes.values.to_numpy() if codes.is_valid else np.zeros(0, np.int64))
            edge = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(data)]
            kept = hashlib.sha256()
            for a, b in zip(edge[::2], edge[1::2]):
                kept.update(data[a:b])
            for c, v in zip((n, gone, runs, sha, starts, ends), (len(data), int((hi - lo).sum()), len(lo), kept.hexdigest(), lo.tolist(), hi.tolist())):
                c.append(v)
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([p.column(0), *cols], ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def removed(n: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs from codes (position * 65536 + left extension * 256 + depth), cut at the ends of the text."""
    pos, reach, depth = codes >> 16, codes >> 8 & 255, codes & 255
    lo, hi = np.maximum(0, pos - reach), np.minimum(n, pos + depth)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi
    new = np.append(True, lo[1:] > hi[:-1])[: len(lo)]
    last = np.append(new[1:], True)[: len(lo)]
    return lo[new], hi[last]


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: several branches use it, and its lineage reads the texts."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def dedup(docs: DataFrame, bucket: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends): the repeated runs of every document, in bytes."""
    batches(docs.sparkSession)
    nobody = F.lit(-(1 << 63)).cast("long")  # stands for a null id in joins
    rows = document_columns(docs).select(F.coalesce("doc_id", nobody).alias("did"), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = rows.mapInArrow(_find, "kmer long, ctx long, did long, key long, pos int")
    kmers = found.groupBy("kmer").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1").select("kmer", (F.col("lo") == F.col("hi")).alias("copies"))
    kmers = _kept(kmers)  # so that the join deals both sides anew and Spark can split a hot K-byte string
    met = _kept(found.join(kmers, "kmer"))
    whole = F.lit(LEFT * 256 + N).cast("long")
    settled = met.where("copies").select("did", "key", "pos", whole.alias("code"))

    mixed = met.where("not copies").drop("copies")
    contexts = _kept(mixed.groupBy("kmer", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("did", "key", "pos")).alias("at")))
    asked = contexts.select("at.did", "at.key", F.struct("at.pos", "kmer", "ctx").alias("r")).groupBy("did", "key").agg(F.collect_list("r").alias("own"))
    bodies = rows.join(asked, ["did", "key"]).select("text", "own").mapInArrow(_fetch, "kmer long, ctx long, l int, body binary")
    large = contexts.groupBy("kmer").agg(F.count("*").alias("size")).where(F.col("size") > bucket).select("kmer")
    codes = contexts.where("n > 1").select("kmer", "ctx", whole.alias("code"))
    gathered = bodies
    if not large.isEmpty():
        bodies = _kept(bodies)
        gathered = bodies.join(large, "kmer", "left_anti")
        windows = bodies.join(large, "kmer", "left_semi").select("kmer", "ctx", "l", F.explode(F.expr(f"transform(sequence(0, length(body) - {N}), j -> struct(j, xxhash64(substring(body, j + 1, {N})) as w))")).alias("x"))
        windows = windows.select("kmer", "ctx", F.col("x.w").alias("w"), ((F.col("l") - F.col("x.j")) * 256 + N - F.col("l") + F.col("x.j")).cast("long").alias("code"))
        again = windows.groupBy("kmer", "w").agg(F.count("*").alias("m")).where("m > 1").select("kmer", "w")
        codes = codes.unionByName(windows.join(again, ["kmer", "w"]).select("kmer", "ctx", "code"))
    right = F.expr("substring(body, l + 1)")
    tree = gathered.repartition("kmer").sortWithinPartitions("kmer", right, "ctx").mapInArrow(_scan, "kmer long, ctx long, code long")
    per_context = tree.unionByName(codes).groupBy("kmer", "ctx").agg(F.collect_set("code").alias("codes"))
    inside = mixed.join(per_context, ["kmer", "ctx"]).select("did", "key", "pos", F.explode("codes").alias("code"))
    spans = settled.unionByName(inside).select("did", "key", (F.col("pos").cast("long") * 65_536 + F.col("code")).alias("code")).groupBy("did", "key").agg(F.collect_set("code").alias("codes"))
    out = rows.join(spans, ["did", "key"], "left").select("did", "text", "codes")
    out = out.mapInArrow(_cut, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
    return out.withColumn("doc_id", F.nullif(F.col("did"), nobody)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends")
