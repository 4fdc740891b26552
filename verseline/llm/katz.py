"""Katz backoff bigram model: Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(r) r / c(h)          if the bigram was seen r > 0 times in training
             = a(h) P(w)              otherwise;  a(h) = (1 - sum of the seen) / (1 - sum of P over the seen), 1 for a context never seen
    P(w)     = d1(r) r / N            for a known word;  the mass left over for one unknown word

d(r) is the Good-Turing discount for r up to 5, 1 above; where the counts of counts give none between 0 and 1, it is (r - 0.5) / r. A level or
context in which nothing is discounted sets half a count aside, so that every probability is positive. Both
levels sum to one over the vocabulary and the unknown word, for every context.

The text is read once into token blocks of bounded size, a table in the shared folder: the distinct words of a block by hash, their training counts,
and the token sequence as places in that list. From there on packed arrays move, one row per (block, bucket):

1. words by hash bucket: the unigram table; every block gets back the number and the count of each of its words;
2. bigrams by context bucket, with the documents that they stand in: the bigram table. A context with over 1 / (4 buckets) of all tokens is
   spread over the buckets by its successors, and only sums of its parts are brought together, so no context is gathered;
3. counts of counts and the weights of the spread contexts: a table of at most 4 rows per bucket and one of totals, all that the driver sees;
4. every bucket evaluates its bigrams and sends one sum per document of a block back. The packed bigrams are made anew for this, as two copies
   of them on disk would cost more than the work.

The model follows from all training rows; nothing is sampled or cut. Words are runs without white space with A-Z lowered, then one end token;
the context of a first word is the end token. Defined results: null and empty texts hold the end token alone; equal rows count each;
a null id counts as the text '' for the fold; with no training row every token is unknown and has probability one, its base score is
log10(1 / 1) = 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, document_columns, held_out, offsets_of, shared_folder

K = 5
END = b"\n"  # no word holds white space
BLOCK, LONGEST = 2_000_000, 1_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers (or floats) with their widths: least type, byte planes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind != "f":
            top = int(a.max(initial=0))
            a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        body = zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        raw = zstandard.decompress(data[at + 20 : at + 20 + size]) if size else b""
        planes = np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(a if kind.kind == "f" or kind.itemsize == 8 else a.astype(np.int64))
        at += 20 + size
    return out


def _long(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


# --- token blocks -----------------------------------------------------------------------------------------------------------


def _read(block_tokens: int, longest: int):
    """(doc_id, held, text) -> token blocks of about ``block_tokens``; longer documents are cut at ``longest`` tokens."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, row = TaskContext.get().partitionId(), 0, 0
        digest = xxhash.xxh3_64_intdigest
        known: dict[bytes, int] = {END: 0}
        pieces: list[tuple] = []  # row, doc_id, held, first context, token places

        def close() -> pa.RecordBatch:
            hashes = np.fromiter(map(digest, known), dtype=np.uint64, count=len(known))
            order = np.argsort(hashes)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            lens = np.array([len(p[4]) for p in pieces])
            seq = place[np.concatenate([p[4] for p in pieces])]
            held = np.array([p[2] for p in pieces], dtype=np.int64)
            train = np.bincount(seq[np.repeat(held == 0, lens)], minlength=len(known))
            body = pack(np.array([p[0] for p in pieces]), held, lens, place[[p[3] for p in pieces]], seq)
            cols = [pa.array([task << 32 | block], pa.int64()), pa.array([int(lens[held == 0].sum())], pa.int64()), pa.array([int(lens.sum())], pa.int64())]
            cols += [pa.array([[p[1] for p in pieces]], pa.list_(pa.int64())), pa.array([hashes[order].tobytes()], pa.binary()), pa.array([pack(train)], pa.binary()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "train", "tokens", "doc_ids", "words", "counts", "body"])

        size = 0
        for p in parts:
            for doc_id, held, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(2)):
                words = text.as_py().encode("utf-8", "replace").lower().split()
                words.append(END)
                first, last = 0, END
                for lo in range(0, len(words), longest):
                    own = words[lo : lo + longest]
                    for w in set(own).difference(known):
                        known[w] = len(known)
                    first = known.setdefault(last, len(known))
                    last = own[-1]
                    pieces.append((task << 40 | row, doc_id, held, first, np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))))
                    size += len(own)
                    if size >= block_tokens:
                        yield close()
                        known, pieces, size, block = {END: 0}, [], 0, block + 1
                row += 1
        if pieces:
            yield close()

    return run


# --- step 1: the unigram table ----------------------------------------------------------------------------------------------


def _ask(bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for block, words, counts in zip(*[p.column(c) for c in range(3)]):
                raw = words.as_py()
                h, (n,) = np.frombuffer(raw, dtype="<u8"), unpack(counts.as_py())
                bucket = _long(h >> np.uint64(64 - bits))
                edge = np.append(np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0], len(h))
                cells = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
                cols = [pa.array([int(bucket[a]) for a, _ in cells], pa.int64()), pa.array([block.as_py()] * len(cells), pa.int64()), pa.array([raw[8 * a : 8 * b] for a, b in cells], pa.binary()), pa.array([pack(n[a:b]) for a, b in cells], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "words", "counts"])

    return run


def _by_bucket(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket; the input is sorted by it."""
    held, now = [], None
    for p in parts:
        for r in zip(*[c.to_pylist() for c in p.columns]):
            if r[0] != now and held:
                yield now, held
                held = []
            now = r[0]
            held.append(r)
    if held:
        yield now, held


def _number(bits: int):
    """Number every word of a bucket, sum its training counts, answer each block; the bucket's totals go with one answer."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(parts):
            hashes = np.concatenate([np.frombuffer(r[2], dtype="<u8") for r in rows])
            counts = np.concatenate([unpack(r[3])[0] for r in rows])
            distinct, inverse = np.unique(hashes, return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
            stats = [int((total > 0).sum()), int(total.sum()), *np.bincount(total[(total > 0) & (total <= K + 1)], minlength=K + 2)[1:].tolist()]
            at, cells = 0, []
            for i, r in enumerate(rows):
                own = inverse[at : at + len(r[2]) // 8]
                at += len(own)
                cells.append((r[1], bucket, pack((own << bits) | bucket, total[own]), stats if i == 0 else None))
            block, bucket_, body, stat = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket_, pa.int64()), pa.array(body, pa.binary()), pa.array(stat, pa.list_(pa.int64()))], ["block", "bucket", "answer", "stats"])

    return run


# --- step 2: bigrams by context ---------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pairs(bits: int, spread: int):
    """(block, answers, doc_ids, body) -> (bucket, block, cell, info): bigrams of a block by bucket, and once per block what documents need besides."""
    mask = np.uint64((1 << bits) - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for block, answers, doc_ids, body in zip(*[p.column(c) for c in range(4)]):
                block, stats, ids, counts = block.as_py(), np.zeros(K + 3, dtype=np.int64), [], []
                for a in sorted(answers.as_py(), key=lambda a: a["bucket"]):
                    i, c = unpack(a["answer"])
                    ids.append(_long(i))
                    counts.append(_long(c))
                    stats += np.array(a["stats"] or [0] * len(stats))
                ids, counts = np.concatenate(ids), np.concatenate(counts)
                row, held, lens, first, seq = map(_long, unpack(body.as_py()))
                ends = offsets_of(lens)
                before = np.append(0, seq[:-1])
                before[ends[:-1]] = first
                doc = np.repeat(np.arange(len(lens)), lens)
                known = np.bincount(doc, weights=counts[seq] > 0, minlength=len(lens)).astype(np.int64)
                base = np.bincount(doc, weights=np.log10(counts[seq] + 1.0), minlength=len(lens))
                rank = np.empty(len(ids), dtype=np.int64)
                by_id = np.argsort(ids)
                rank[by_id] = np.arange(len(ids))
                mixed, hot = _mix(ids), counts > spread
                bucket = np.where(hot[before], _mix(ids[before].astype(np.uint64) ^ mixed[seq]), mixed[before]) & mask
                key = bucket << np.uint64(48) | rank[before].astype(np.uint64) << np.uint64(24) | rank[seq].astype(np.uint64)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
                occ = np.diff(np.append(start, len(key)))
                train = np.add.reduceat((held[doc] == 0).astype(np.int64), start)
                own = _long(key[start])
                one, two, where = by_id[own >> 24 & 0xFFFFFF], by_id[own & 0xFFFFFF], _long(key[start] >> np.uint64(48))
                cells = []
                edge = np.append(np.nonzero(np.append(True, where[1:] != where[:-1]))[0], len(where))
                offs = np.append(start, len(key))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    cells.append((int(where[a]), pack(np.append(ids[one[a]], np.diff(ids[one[a:b]])), ids[two[a:b]], counts[two[a:b]], hot[one[a:b]], train[a:b], occ[a:b], doc[offs[a] : offs[b]])))
                where_, cell = zip(*cells)
                info = [None] * len(cells)
                info[0] = {"stats": stats.tolist(), "doc_ids": doc_ids.as_py(), "body": pack(row, held, lens, known, base)}
                kind = pa.struct([("stats", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(where_, pa.int64()), pa.array([block] * len(cells), pa.int64()), pa.array(cell, pa.binary()), pa.array(info, kind)], ["bucket", "block", "cell", "info"])

    return run


class Bigrams:
    """The bigrams of one bucket: parts of blocks brought together, sorted by context and word."""

    def __init__(self, rows: list[tuple]):
        parts = [[_long(a) for a in unpack(r[2])] for r in rows]
        for p in parts:
            p[0] = np.cumsum(p[0])
        one, two, count, hot, train, occ = (np.concatenate([p[i] for p in parts]) for i in range(6))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        start = np.nonzero(new)[0]
        self.train = np.add.reduceat(train[order], start)
        self.count, self.hot = count[order][start], hot[order][start] > 0
        context = one[start]
        self.first = np.nonzero(np.append(True, context[1:] != context[:-1]))[0]
        self.context, self.size = context[self.first], np.diff(np.append(self.first, len(context)))
        # for every part: which bigram its entries are, how often and where they stand
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        ends = offsets_of([len(p[0]) for p in parts])
        self.parts = [(r[1], place[a:b], p[5], p[6]) for r, p, a, b in zip(rows, parts, ends, ends[1:])]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per context."""
        return np.add.reduceat(values, self.first)


def classes(n: np.ndarray) -> np.ndarray:
    """0 for no count, r up to K, K + 1 above."""
    return np.minimum(n, K + 1)


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of counts, and of each spread context what its weight needs: (context, sums). Context -1 holds the totals.

    Sums of a context: seen bigrams with r = 1..K, tokens of those above; the same by the count of the second word; all its tokens.
    """
    for _, rows in _by_bucket(parts):
        total = np.zeros(2 * K + 5, dtype=np.int64)
        for r in rows:
            if r[3]:
                total[: K + 3] += np.array(r[3]["stats"])
        b = Bigrams(rows)
        few = b.train[(b.train > 0) & (b.train <= K + 1)]
        total[K + 3 : 2 * K + 5 - 1] += np.bincount(few, minlength=K + 2)[1 : K + 2]
        out = [(-1, total.tolist())]
        spread = np.nonzero(b.hot[b.first])[0]
        for i in spread.tolist():
            a, z = b.first[i], b.first[i] + b.size[i]
            seen = b.train[a:z] > 0
            r, c = b.train[a:z][seen], b.count[a:z][seen]
            one, two = np.bincount(classes(r), minlength=K + 2)[1 : K + 1], np.bincount(classes(c), minlength=K + 2)[1 : K + 1]
            out.append((int(b.context[i]), [*one.tolist(), int(r[r > K].sum()), *two.tolist(), int(c[c > K].sum()), int(r.sum()), 0, 0]))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))], ["context", "sums"])


# --- step 3: the discounts --------------------------------------------------------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) = 0, d(1) .. d(K), d(above) = 1 from the counts of counts n[0] = n_1 .. n[K] = n_(K+1)."""
    d = np.ones(K + 2)
    d[0] = 0.0
    n = n.astype(float)
    for r in range(1, K + 1):
        value = 0.0
        if n[0] > 0 and n[r - 1] > 0:
            cut = (K + 1) * n[K] / n[0]
            value = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if cut < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Model:
    """Discounts of both levels, totals, and the weights of the spread contexts."""

    def __init__(self, rows: list[dict]):
        total = next((np.array(r["sums"]) for r in rows if r["context"] == -1), np.zeros(2 * K + 5, dtype=np.int64))
        self.vocabulary, self.tokens = int(total[0]), int(total[1])
        self.d1, self.d2 = discounts(total[2 : K + 3]), discounts(total[K + 3 : 2 * K + 4])
        kept = sum(self.d1[r] * r * total[1 + r] for r in range(1, K + 1)) + self.tokens - sum(r * total[1 + r] for r in range(1, K + 1))
        self.unknown = 1 - kept / self.tokens if self.tokens else 1.0
        if self.tokens and self.unknown < 1e-12:  # no word is rare enough for a discount: take half a count
            self.unknown = 0.5 / (self.tokens + 0.5)
            self.scale = (1 - self.unknown) / (kept / self.tokens)
        else:
            self.scale = 1.0
        spread = sorted((r["context"], r["sums"]) for r in rows if r["context"] != -1)
        self.context = np.array([c for c, _ in spread], dtype=np.int64)
        s = np.array([s for _, s in spread], dtype=float).reshape(len(spread), 2 * K + 5)
        steps = np.arange(1, K + 1)
        self.of_context = s[:, 2 * K + 2]
        seen = (s[:, :K] * self.d2[1 : K + 1] * steps).sum(axis=1) + s[:, K]
        lower = ((s[:, K + 1 : 2 * K + 1] * self.d1[1 : K + 1] * steps).sum(axis=1) + s[:, 2 * K + 1]) / max(1, self.tokens) * self.scale
        self.kept, self.weight = backoff(seen, self.of_context, lower)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) of words with these training counts."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, self.d1[classes(count)] * count / self.tokens * self.scale, self.unknown)

    def evaluate(self, b: Bigrams) -> np.ndarray:
        """log10 P(w | h) of every bigram of the bucket: seen, or the weight of its context times the lower level."""
        lower, seen = self.unigram(b.count), b.train > 0
        mass = self.d2[classes(b.train)] * b.train
        total = b.sums(b.train).astype(float)
        kept, weight = backoff(b.sums(mass), total, b.sums(np.where(seen, lower, 0.0)))
        at = np.nonzero(b.hot[b.first])[0]
        if len(at) and len(self.context):
            own = np.minimum(np.searchsorted(self.context, b.context[at]), len(self.context) - 1)
            total[at], kept[at], weight[at] = self.of_context[own], self.kept[own], self.weight[own]
        which = np.repeat(np.arange(len(b.first)), b.size)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen, kept[which] * mass / total[which], weight[which] * lower)
        return np.log10(p)


def backoff(seen: np.ndarray, total: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the seen words and weights of the others, from the discounted counts, the count and the lower-level mass of the seen words
    of each context. Where no count is small enough for a discount, half a count is set aside; a context never seen has weight 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(total > 0, seen / total, 0.0)
        kept = np.where(share > 1 - 1e-12, total / (total + 0.5), 1.0)
        return kept, np.where(total > 0, (1 - kept * share) / (1 - lower), 1.0)


# --- step 4: scores ---------------------------------------------------------------------------------------------------------


def _score(model: Model):
    """(bucket, block, cell, info) -> (block, sums): per block, what its documents lose in this bucket, in units of 1e-9; infos pass through."""
    kind = pa.struct([("stats", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("body", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(parts):
            b, out = Bigrams(rows), []
            logs = -model.evaluate(b)
            for _, place, occ, doc in b.parts:
                out.append(pack(np.rint(np.bincount(doc, weights=np.repeat(logs[place], occ)) * 1e9).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(out, pa.binary()), pa.array([r[3] for r in rows], kind)], ["block", "sums", "info"])

    return run


def _finish(v: int, n: int):
    """Sum the parts of each block and give its documents (pieces of one document still apart); vocabulary and training tokens."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(parts):
            info = next(r[2] for r in rows if r[2])
            row, held, lens, known, base = unpack(info["body"])
            total = np.zeros(len(lens))
            for r in rows:
                (own,) = unpack(r[1])
                total[: len(own)] -= own / 1e9
            base = base.astype(float) - _long(lens) * np.log10(n + v + 1.0)
            cols = [pa.array(_long(row)), pa.array(info["doc_ids"], pa.int64()), pa.array(_long(held) > 0), pa.array(_long(lens)), pa.array(_long(known)), pa.array([n] * len(lens), pa.int64()), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, buckets: int | None = None, block_tokens: int = BLOCK, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    batches(spark)
    folder = shared_folder(spark)
    rows = document_columns(docs).select("doc_id", held_out("doc_id", modulus, remainder).alias("held"), "text")
    rows.mapInArrow(_read(block_tokens, longest), "block long, train long, tokens long, doc_ids array<long>, words binary, counts binary, body binary").write.parquet(folder)
    blocks = spark.read.parquet(folder)
    size = blocks.agg(F.sum("train"), F.sum("tokens")).first()
    bits = max(4, min(16, int(np.ceil(np.log2(max(1, (size[1] or 0) / 1_500_000)))))) if buckets is None else int(np.log2(buckets))
    n = 1 << bits
    spread = (size[0] or 0) // (4 * n)
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(bits), "bucket long, block long, words binary, counts binary")
    answers = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_number(bits), "block long, bucket long, answer binary, stats array<long>")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer", "stats")).alias("answers"))
    info = "struct<stats:array<long>,doc_ids:array<long>,body:binary>"
    joined = blocks.select("block", "doc_ids", "body").join(answers, "block").select("block", "answers", "doc_ids", "body")
    cells = joined.mapInArrow(_pairs(bits, spread), f"bucket long, block long, cell binary, info {info}").repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    sums = cells.mapInArrow(_measure, "context long, sums array<long>").select("context", F.posexplode("sums").alias("i", "v")).groupBy("context", "i").agg(F.sum("v").alias("v"))
    tables = sums.groupBy("context").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))
    model = Model([r.asDict() for r in tables.collect()])  # at most 4 contexts for each bucket, and the totals
    scored = cells.mapInArrow(_score(model), f"block long, sums binary, info {info}")
    finish = _finish(model.vocabulary, model.tokens)
    done = scored.repartition("block").sortWithinPartitions("block").mapInArrow(finish, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    firsts, totals = [F.first(c).alias(c) for c in ("doc_id", "held_out", "train_tokens")], [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return done.groupBy("row").agg(*firsts, *totals).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
