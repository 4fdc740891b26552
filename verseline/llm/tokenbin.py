"""Token ids in fixed-width bit-packed segments.

Every id takes the minimum number of bits that the vocabulary needs. A segment is a small file of its own, kept as one binary value of a
Parquet table so that it lands on any store that Spark can write, and whole or not at all:

    magic "VPB1" | bits u32 | ids per block u32 | number of ids u64 | number of blocks u32 | byte offset of each block, and of the end, u64 | blocks

All numbers are little-endian; inside a block the id at place i takes the bits from i * bits on, lowest bit first. Block offsets allow
reading any range of ids without the rest, and a block unpacks in a few numpy operations.

Documents are written in ascending (doc_id, text hash, text) order, null ids first: a range partition per task, a segment per ``segment_ids`` ids.
The end id follows every document. Defined results: null and empty texts hold the end id alone; equal rows are written as often as they
stand there; one document is never cut, so a segment is as long as its longest document needs; an empty table gives an empty table.

Encoding keeps a bounded memory of white-space-separated chunks already encoded: the tokenizer drops white space and never looks across it,
so the ids of a text are those of its chunks (the tests compare with direct encoding).
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseline.llm.common import batches, document_columns, offsets_of, row_key

MAGIC = b"VPB1"
HEAD = struct.Struct("<4sIIQI")
SEGMENTS = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
ROWS = "part int, seq int, place int, doc_id long, inner_start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocabulary))))


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.int64)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def pack(ids: np.ndarray, bits: int, block: int = 1 << 16) -> bytes:
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise ValueError(f"an id does not fit {bits} bits")
    parts = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = offsets_of([len(p) for p in parts]) + HEAD.size + 8 * (len(parts) + 1)
    return HEAD.pack(MAGIC, bits, block, len(ids), len(parts)) + offsets.astype("<u8").tobytes() + b"".join(parts)


class Segment:
    """Random access to one packed segment."""

    def __init__(self, payload: bytes):
        magic, self.bits, self.block, self.n, blocks = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a packed segment")
        self.data, self.offsets = memoryview(payload), np.frombuffer(payload, dtype="<u8", count=blocks + 1, offset=HEAD.size)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else min(hi, self.n)
        if hi <= lo:
            return np.zeros(0, dtype=np.int64)
        first, last = lo // self.block, (hi - 1) // self.block
        got = [unpack_block(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])], min(self.block, self.n - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[lo - first * self.block : hi - first * self.block]


# A word of letters that no normal form changes, and marks behind it: the tokenizer cuts between the two and lowers the first.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|#$%&*+/=@^_~-]*)")


class _Known(dict):
    """Places of chunks; those not known yet are listed as they are asked for, and take a negative place until they are."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = -len(self.new)
        return -len(self.new)


class ChunkEncoder:
    """Encodes texts by their white-space-separated chunks, of which it remembers a bounded number.

    New chunks go to the tokenizer many at a time with the digit 0 between them, whose id tells their ids apart; chunks that hold
    that digit, or could be taken for special tokens, go alone.
    """

    def __init__(self, path: str, most_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_chars
        self.mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known, self.chars, self.flat, self.starts = _Known(), 0, bytearray(), array("q", [0, 0])

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Chunks not known yet, their ids one after the other, and how many each has."""
        first = len(self.starts) - 1
        ends = self.starts[-1] + np.cumsum(sizes, dtype=np.int64)
        self.flat += ids.astype("<u4", copy=False).tobytes()
        self.starts.frombytes(ends.tobytes())
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.chars += sum(map(len, chunks)) + 8 * len(chunks)

    def _read(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all places one after the other, and how many each has; the views are gone before the next chunk is kept."""
        flat, starts = np.frombuffer(self.flat, dtype="<u4"), np.frombuffer(self.starts, dtype=np.int64)
        begin = starts[place]
        size = starts[place + 1] - begin
        before = offsets_of(size)
        return flat[np.arange(int(before[-1])) + np.repeat(begin - before[:-1], size)], size

    def _ask(self, chunks: list[str]) -> None:
        """Encode chunks not known yet."""
        plain = [c for c in chunks if "0" not in c and "<|" not in c and len(self.mark) == 1]
        alone = [c for c in chunks if "0" in c or "<|" in c or len(self.mark) != 1]
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" 0 ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            marks = np.nonzero(ids == self.mark[0])[0]
            if len(marks) + 1 != len(group):
                alone += group
                continue
            self._keep(group, np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1)
        for c, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self._keep([c], np.array(e.ids, dtype="<u4"), np.array([len(e.ids)]))

    def _add(self, chunks: list[str]) -> None:
        """Know these chunks: words with marks behind them by their two parts, the others as they stand."""
        parts = list(map(PLAIN.fullmatch, chunks))
        cut = [(c, m[1].lower(), m[2]) for c, m in zip(chunks, parts) if m]
        new = {c for c, m in zip(chunks, parts) if not m}
        new.update(w for _, w, _ in cut)
        new.update(k for _, _, k in cut)
        self._ask([c for c in new if c not in self.known])
        cut = [x for x in cut if x[0] not in self.known]
        if cut:
            names, words, marks = zip(*cut)
            place = np.array([list(map(self.known.__getitem__, words)), list(map(self.known.__getitem__, marks))], dtype=np.int64).T.ravel()
            ids, size = self._read(place)
            self._keep(names, ids, size.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and their lengths."""
        if self.chars > self.most:
            self.forget()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        counts = [len(c) for c in split]
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(counts))
        if missing := self.known.new:
            self.known.new = []
            for c in missing:
                del self.known[c]
            self._add(missing)
            named = np.fromiter(map(self.known.__getitem__, missing), dtype=np.int64, count=len(missing))
            unnamed = np.nonzero(place < 0)[0]
            place[unnamed] = named[-1 - place[unnamed]]
        found, size = self._read(place)
        lengths = np.diff(offsets_of(size)[offsets_of(counts)]) + 1
        ends = offsets_of(lengths)
        out = np.full(int(ends[-1]), end_id, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[ends[1:] - 1] = False
        out[inside] = found
        return out, lengths


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def segments(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, segment_ids: int = 1 << 20) -> DataFrame:
    """Documents in order, encoded and packed; ``part`` and ``seq`` give the order of segments."""
    batches(docs.sparkSession)
    rows = document_columns(docs).withColumn("key", row_key())
    ordered = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    bits = bits_for(vocabulary)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, doc_ids, lengths, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        enc = encoder(tokenizer)

        def close() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([pack(np.concatenate(ids), bits)], pa.binary())],
                ["part", "seq", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in parts:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in runs([len(t) for t in texts]):
                got, n = enc.encode(texts[lo:hi], end_id)
                ids.append(got)
                lengths.append(n)
                doc_ids += names[lo:hi]
                held += len(got)
                if held >= segment_ids:
                    yield close()
                    seq, ids, doc_ids, lengths, held = seq + 1, [], [], [], 0
        if doc_ids:
            yield close()

    return ordered.mapInArrow(write, SEGMENTS)


def runs(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive items of at most ``most`` together, or one larger item."""
    lo = total = 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > most:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def save(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int, **options) -> None:
    segments(docs, tokenizer, vocabulary, end_id, **options).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the segments.

    ``start`` adds the totals of earlier partitions (as many rows as there are files), of earlier segments, and the place in the segment.
    """
    segs = spark.read.parquet(folder)

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, seq, doc_ids, lengths, payload in zip(*[batch.column(c) for c in ("part", "seq", "doc_ids", "lengths", "payload")]):
                seg, ends = Segment(payload.as_py()), offsets_of(lengths.as_py())
                ids = seg.ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
                k = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(doc_ids.as_py(), pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    ["part", "seq", "place", "doc_id", "inner_start", "n_tokens", "ids_crc32"],
                )

    sizes = segs.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    totals = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = sizes.withColumn("seq_start", F.sum("n_ids").over(within) - F.col("n_ids")).join(totals, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    rows = segs.mapInArrow(unpack, ROWS).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("base") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32")
