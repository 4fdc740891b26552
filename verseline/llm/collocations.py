"""Phrase collocations per language, with Misra-Gries summaries per hash partition.

Texts are lower-cased (A-Z only), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. A phrase of 2 to 4 words
is a candidate if it occurs at least ``threshold`` times in its language.

First pass, level by level (words, pairs, longer phrases): every task counts the hashes of its phrases and hands them to hash partitions; each
partition merges what arrives into one Misra-Gries summary (a merge that leaves more counters than the capacity takes the value of the first
surplus one from all). What has been taken in all, ``taken``, bounds the error of every counter. The capacity exceeds the partition's share of
the mass divided by the threshold, so ``taken`` stays below the threshold and every frequent phrase keeps a counter; should one partition hold
more than its share, its capacity grows rather than let ``taken`` reach the threshold. A counter that could not reach the threshold with
``taken`` added goes. A phrase is looked at only if its parts of the level before survived; the survivors travel as a bitmap of fixed size,
which may let others through, never lose one. Second pass: the phrases whose hashes survived are counted exactly, by their texts.

Defined results: a null or empty text has no words; a null lang counts as ``und``; repeated rows count as often as they occur; rows with a null
doc_id count like any other; ties of the score go to the larger count, then to the phrase that is less in UTF-8 byte order; tables without
candidates give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.common import batches, checkpointed, field, offsets_of

U = np.uint64
#: Odd bases of the two hashes of a word, and a multiplier that mixes.
BASES, MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)
WORD, GAP, CUT = 0, 1, 2
#: Bytes of text that are split at once: the arrays beside it are some thirty times as large.
SLICE = 2 << 20

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = GAP
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * MIX
    return h ^ (h >> U(29))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, self.base, dtype=U)]))
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, self.inverse, dtype=U)]))


class Words:
    """The words of a run of texts: byte ranges, language, piece, and the hash of each word (seeded by its language)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, powers: list[Powers]):
        self.data = data = _LOWER[data]
        self.glued, self.broken = None, False
        kind = _CLASS[data]
        inner = kind == WORD
        first = offsets[:-1][np.diff(offsets) > 0]  # first byte of every text that is not empty
        starts = inner.copy()
        starts[1:] &= ~inner[:-1]
        starts[first] = inner[first]
        ends = inner.copy()
        ends[:-1] &= ~inner[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inner[last]
        cuts = kind == CUT
        piece = np.cumsum(cuts)
        self.start, self.end = np.nonzero(starts)[0], np.nonzero(ends)[0] + 1
        doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.piece = piece[self.start] + doc
        self.lang = langs[doc]
        seed = _mixed(self.lang.astype(U) + U(1))
        self.hashes = []
        for p in powers:
            p.reach(len(data) + 1)
            run = np.zeros(len(data) + 1, dtype=U)
            np.cumsum((data.astype(U) + U(1)) * p.up[: len(data)], out=run[1:])
            self.hashes.append(_mixed((run[self.end] - run[self.start]) * p.down[self.start] ^ seed))

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; of use only where ``whole`` holds."""
        h = self.hashes[which]
        if n == 1:
            return h
        out = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            out = _mixed(out * U(31) + h[k : len(h) - n + 1 + k])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one piece."""
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n])).decode("utf-8", "replace")

    def phrases(self, at: np.ndarray, n: int) -> pa.StringArray:
        """Texts of the n words from each of ``at`` on, cut at once out of the words with one blank behind each."""
        if self.glued is None:
            size = self.end - self.start
            self.begin = offsets_of(size + 1)
            word = np.ones(self.begin[-1], dtype=bool)
            word[self.begin[1:] - 1] = False
            self.glued = np.full(len(word), 0x20, dtype=np.uint8)
            self.glued[word] = self.data[_CLASS[self.data] == WORD]
            try:
                self.glued.tobytes().decode("utf-8")
            except UnicodeDecodeError:
                self.broken = True
        if self.broken:
            return pa.array([self.phrase(int(i), n) for i in at], pa.string())
        lo = self.begin[at]
        offsets = offsets_of(self.begin[at + n] - 1 - lo)
        data = self.glued[np.repeat(lo - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _read(parts: Iterator[pa.RecordBatch], names: dict, powers: list[Powers]) -> Iterator[Words]:
    """Splits (lang, text) batches; a text longer than a slice is a slice of its own. names: language to a number of this task."""
    for b in parts:
        column = b.column(1).cast(pa.large_string())
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        codes = np.array([_name(names, x) for x in b.column(0).to_pylist()], dtype=np.uint64)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], codes[lo:hi], powers)
            if len(w.start):
                yield w
            lo = hi


def _name(names: dict, lang: str) -> int:
    """A number that depends on the language alone, so that hashes agree between tasks."""
    if lang not in names:
        import hashlib

        names[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=7).digest(), "big")
    return names[lang]


class Bitmap:
    """Set of hashes with false positives, of ``1 << bits`` bits."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.shift, self.words = U(64 - bits), np.zeros(1 << (bits - 6), dtype=U) if words is None else words

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def _passing(w: Words, n: int, maps: dict[int, Bitmap]) -> np.ndarray:
    """Starts of phrases of n words in one piece whose parts one word shorter may be frequent, as far as ``maps`` knows."""
    ok = w.whole(n)
    k = n - 1
    while k and k not in maps:
        k -= 1
    if k:
        part = maps[k].holds(w.grams(k))
        for j in range(n - k + 1):
            ok = ok & part[j : j + len(ok)]
    return np.nonzero(ok)[0]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, dtype=np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


def _local_counts(sizes: tuple[int, ...], maps: dict[int, Bitmap], most: int):
    """For mapInArrow: (lang, text) -> (h, n), counts of the task's own phrases, at most ``most`` of them held at a time."""

    def run(parts):
        powers, names, held, size = [Powers(BASES[0])], {}, [], 0
        for w in _read(parts, names, powers):
            for n in sizes:
                h, c = np.unique(w.grams(n)[_passing(w, n, maps)], return_counts=True)
                held.append((h, c))
                size += len(h)
            if size >= most:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size >= most // 2:
                    yield from emit(*held[0])
                    held, size = [], 0
        if held:
            yield from emit(*_summed(*map(np.concatenate, zip(*held))))

    def emit(h, n):
        for lo in range(0, len(h), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 18)].view(np.int64)), pa.array(n[lo : lo + (1 << 18)].astype(np.int64))], ["h", "n"])

    return run


class Summary:
    """Mergeable Misra-Gries summary in sorted arrays."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.h, self.n = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)

    def merge(self, h: np.ndarray, n: np.ndarray) -> None:
        self.h, self.n = _summed(np.concatenate([self.h, h]), np.concatenate([self.n, n]))
        if len(self.h) > self.capacity:
            surplus = int(np.partition(self.n, len(self.n) - self.capacity - 1)[len(self.n) - self.capacity - 1])
            if self.taken + surplus >= self.threshold:
                self.capacity = 2 * len(self.h)  # more than its share of the mass lies here
                return
            self.taken += surplus
            left = self.n > surplus
            self.h, self.n = self.h[left], self.n[left] - surplus

    def survivors(self) -> np.ndarray:
        return self.h[self.n + self.taken >= self.threshold]


def _summaries(capacity: int, threshold: int):
    """For mapInArrow over one hash partition: (h, n) -> h of the survivors."""

    def run(parts):
        summary, held, size = Summary(capacity, threshold), [], 0
        for b in parts:
            held.append((b.column(0).to_numpy().view(U), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= capacity:
                summary.merge(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            summary.merge(*map(np.concatenate, zip(*held)))
        h = summary.survivors().view(np.int64)
        for lo in range(0, len(h), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 18)])], ["h"])

    return run


def _survivors(texts: DataFrame, sizes: tuple[int, ...], maps: dict[int, Bitmap], threshold: int, mass: int, capacity: int, bits: int) -> Bitmap:
    """Bitmap of the hashes of phrases of these sizes that may be frequent."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * mass // (threshold * capacity)))
    counted = texts.mapInArrow(_local_counts(sizes, maps, capacity), "h long, n long")
    alive = counted.repartition(parts, "h").mapInArrow(_summaries(capacity, threshold), "h long")
    at = F.shiftrightunsigned("h", 64 - bits)
    words = alive.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("mask"))
    got = words.toArrow()  # at most 1 << (bits - 6) rows
    out = Bitmap(bits)
    out.words[got["word"].to_numpy()] = got["mask"].to_numpy().view(U)
    return out


def _exact_counts(sizes: tuple[int, ...], maps: dict[int, Bitmap]):
    """For mapInArrow: (lang, text) -> (lang, size, phrase, n); size 0 counts all words."""

    def run(parts):
        powers, names = [Powers(b) for b in BASES], {}
        for w in _read(parts, names, powers):
            of = {v: k for k, v in names.items()}
            codes, code, totals = np.unique(w.lang, return_inverse=True, return_counts=True)
            langs = pa.array([of[int(x)] for x in codes], pa.string())
            yield rows(langs, 0, pa.array([""] * len(langs), pa.string()), totals)
            for n in sizes:
                h = w.grams(n)
                at = np.nonzero(w.whole(n) & maps[n].holds(h))[0]
                h, g = h[at], w.grams(n, 1)[at]
                _, first, same, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                if (g != g[first][same]).any():  # two phrases of one hash: the second hash tells them apart
                    _, first, count = np.unique(np.stack([h, g], axis=1), axis=0, return_index=True, return_counts=True)
                for lo in range(0, len(first), 50_000):
                    i = at[first[lo : lo + 50_000]]
                    yield rows(langs.take(pa.array(code[i])), n, w.phrases(i, n), count[lo : lo + 50_000])

    def rows(langs, n, texts, count):
        return pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(langs), n, dtype=np.int32)), texts, pa.array(count.astype(np.int64))], ["lang", "size", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, longest: int = 4, threshold: int = 30, capacity: int = 1 << 20, bits: int = 26) -> DataFrame:
    """(lang, size, phrase, n): every phrase of 1 to ``longest`` words that occurs ``threshold`` times or more in its language, with its exact
    count; size 0 and an empty phrase: all words of the language."""
    batches(docs.sparkSession)
    texts = docs.select(F.coalesce(field(docs, "lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(field(docs, "text").cast("string"), F.lit("")).alias("text"))
    mass = (texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // 2 + 1  # a word and what follows it take two bytes
    maps = {}
    for sizes in [(1,), (2,), tuple(range(3, longest + 1))]:
        if sizes and sizes[0] <= longest:
            alive = _survivors(texts, sizes, dict(maps), threshold, mass * len(sizes), capacity, bits)
            maps |= {n: alive for n in sizes}
    counted = texts.mapInArrow(_exact_counts(tuple(range(1, longest + 1)), maps), "lang string, size int, phrase string, n long")
    total = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("size") == 0) | (F.col("n") >= threshold))


def collocations(docs: DataFrame, longest: int = 4, threshold: int = 30, keep: int = 2000, **summary) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best candidates of each language.

    The score of a cut after k words is floor(2000000 a / (l + r)), with l and r the counts of the two parts; the lowest cut counts, ties to
    the smallest k. A candidate inside a longer candidate with at least 0.8 of its count is left out.
    """
    all_ = checkpointed(frequent_phrases(docs, longest, threshold, **summary))
    totals = all_.where("size = 0").select("lang", F.col("n").alias("total"))
    counts = all_.where("size > 0").select("lang", "phrase", "n")
    found = all_.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def words(lo, n):
        return F.array_join(F.slice("w", lo, n), " ")

    def inner(x):
        return F.transform(F.sequence(F.lit(1), F.col("size") - 1), x)

    parts = found.select("lang", "phrase", "a", F.explode(inner(lambda k: F.struct(k.alias("k"), words(1, k).alias("left"), words(k + 1, F.col("size") - k).alias("right")))).alias("c")).select("lang", "phrase", "a", "c.*")
    sides = parts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    sides = sides.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = sides.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")

    longer = found.where("size > 2").select(
        "lang", "a",
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: words(i, n))))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where("outer is null or cast(outer as decimal(19,0)) * 5 < cast(a as decimal(19,0)) * 4")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
