"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of five-word shingles into classes of doubling size. For a class of at most U shingles a document
is read in windows of 2U shingles that start every U, so that an item that stands in it lies inside one window and the Jaccard similarity
of item and window is bounded below by the containment and the class, however long the document is. Item and window become a candidate
pair when one of ``HASHES`` minima is the same; items of fewer than ``TINY`` shingles are looked up by all their shingles. At the
threshold of 0.8 a window misses an item that stands in one piece with probability below 1e-5, and one in two halves below 0.5 %.
Every candidate is then verified over the whole document: the share of the item's distinct shingles, compared as words, that the
document has.

Words are runs without white space in the text with A-Z lowered. Defined results: null and empty texts match nothing; items with fewer than
five words hold no shingle and are never reported; equal rows of documents are reported each, equal items by each of their ids; null ids are
kept; extra columns are ignored by ``search`` and kept by ``keep_clean``.

No document leaves its task: the items are the query set and go to the tasks in blocks of bounded bytes, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, document_columns, field, offsets_of

SHINGLE, HASHES, TINY, CELL = 5, 64, 8, 16
FILTER_BITS = 18


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of the shingle that starts at each word; the last four places are left out."""
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    if len(h) < SHINGLE:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    g = h[:n].copy()
    for k in range(1, SHINGLE):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(31)
        g += h[k : n + k]
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return g


def _shingles(words: list[bytes]) -> set:
    return set(zip(*[words[k:] for k in range(SHINGLE)]))


class Searcher:
    """Index of one block of items."""

    def __init__(self, items: list[str | None], threshold: float):
        words = [words_of(t) for t in items]
        self.threshold, self.sets = threshold, [_shingles(w) if len(w) >= SHINGLE else set() for w in words]
        rng = np.random.default_rng(20_240)
        self.odd = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tiny, classes = [], {}
        for i, (w, s) in enumerate(zip(words, self.sets)):
            if not s:
                continue
            h = np.unique(shingle_hashes(w))
            if len(h) < TINY:
                tiny += [(v, i) for v in h.tolist()]
            else:
                size = CELL
                while size < len(h):
                    size *= 2
                classes.setdefault(size, []).append((i, [(h * a).min() for a in self.odd]))
        self.tiny = self._table(tiny)
        self.classes = [(size, [self._table([(int(m[k]), i) for i, m in own]) for k in range(HASHES)]) for size, own in sorted(classes.items())]

    @staticmethod
    def _table(pairs: list[tuple[int, int]]):
        """Sorted values with their items, and a filter over the low bits."""
        if not pairs:
            return None
        pairs.sort()
        values = np.array([v for v, _ in pairs], dtype=np.uint64)
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[(values & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return values, np.array([i for _, i in pairs]), seen

    @staticmethod
    def _probe(table, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``values``, item) of every equal value."""
        known, items, seen = table
        at = np.nonzero(seen[(values & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int32)])[0]
        lo, hi = np.searchsorted(known, values[at], side="left"), np.searchsorted(known, values[at], side="right")
        many = hi - lo
        inner = np.arange(int(many.sum())) - np.repeat(offsets_of(many)[:-1], many)
        return np.repeat(at, many), items[np.repeat(lo, many) + inner]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every pair that reaches the threshold."""
        words = [words_of(t) for t in texts]
        ends = offsets_of([len(w) for w in words])
        stream = shingle_hashes([w for own in words for w in own])
        if not len(stream):
            return []
        found = set()

        def note(lo: np.ndarray, width: int, items: np.ndarray) -> None:
            """Candidates: the texts that the windows touch."""
            for a, i in set(zip(lo.tolist(), items.tolist())):
                first = int(np.searchsorted(ends, a, side="right")) - 1
                last = int(np.searchsorted(ends, min(a + width, int(ends[-1])) - 1, side="right")) - 1
                found.update((d, i) for d in range(max(0, first), last + 1))

        if self.tiny:
            at, items = self._probe(self.tiny, stream)
            note(at, 1, items)
        if self.classes:
            for base in range(0, len(stream), 1 << 16):
                # one cell more than the piece, so that windows go on over its end
                most = max(size for size, _ in self.classes)
                part = stream[base : base + (1 << 16) + 2 * most]
                cells = -(-len(part) // CELL)
                square = np.full(cells * CELL, part[-1], dtype=np.uint64)
                square[: len(part)] = part
                square = np.ascontiguousarray(square.reshape(cells, CELL).T)
                for k in range(HASHES):
                    low, size = (square * self.odd[k]).min(axis=0), CELL
                    for wanted, tables in self.classes:
                        while size < wanted:  # cells of twice the size
                            if len(low) % 2:
                                low = np.append(low, low[-1])
                            low, size = np.minimum(low[0::2], low[1::2]), size * 2
                        window = np.minimum(low, np.append(low[1:], low[-1]))
                        at, items = self._probe(tables[k], window)
                        note(base + at * size, 2 * size, items)
        out, candidates = [], {}
        for d, i in sorted(found):
            candidates.setdefault(d, []).append(i)
        for d, items in candidates.items():
            own = _shingles(words[d])
            for i in items:
                shared = len(self.sets[i] & own)
                if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                    out.append((d, i, shared))
        return out


_SEARCHERS: dict = {}


def _searcher(items: tuple, threshold: float) -> Searcher:
    """One per worker and block: hashes of words differ between Python processes, so the index is made where it is used."""
    key = (hash(items), threshold)
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(list(items), threshold)
    return _SEARCHERS[key]


def _pieces(texts: list[str | None], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t or "") > most:
            yield lo, i
            lo, total = i, 0
        total += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def item_blocks(benchmark: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks of bounded bytes."""
    rows = benchmark.select(field(benchmark, "item_id").cast("long").alias("item_id"), F.coalesce(field(benchmark, "text").cast("string"), F.lit("")).alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) of every document that holds the threshold's share of an item's shingles."""
    batches(docs.sparkSession)
    rows, out = document_columns(docs), None
    schema = "doc_id long, item_id long, shared long, n_shingles long, containment double"
    for block in item_blocks(benchmark, block_bytes):
        ids, texts = [i for i, _ in block], tuple(t for _, t in block)

        def run(parts: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            for p in parts:
                own, names = p.column(1).to_pylist(), p.column(0).to_pylist()
                s = _searcher(texts, threshold)
                for lo, hi in _pieces(own):
                    got = [(names[lo + d], ids[i], n, len(s.sets[i]), n / len(s.sets[i])) for d, i, n in s.search(own[lo:hi])]
                    if got:
                        cols = [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(),) * 4 + (pa.float64(),))]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "shared", "n_shingles", "containment"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _clean(texts: tuple, threshold: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        own, out = text.tolist(), np.ones(len(text), dtype=bool)
        for lo, hi in _pieces(own):
            for d, _, _ in _searcher(texts, threshold).search(own[lo:hi]):
                out[lo + d] = False
        return pd.Series(out)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    batches(docs.sparkSession)
    for block in item_blocks(benchmark, block_bytes):
        docs = docs.where(_clean(tuple(t for _, t in block), threshold)(F.coalesce(field(docs, "text").cast("string"), F.lit(""))))
    return docs
