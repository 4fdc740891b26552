"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces of that length and a rest. Pieces are packed best-fit decreasing: the fullest
open bin that still has room takes the piece. When none has, the bin size with the least cost per token it is expected to hold is opened: it takes
as many pieces of this length as fit, and counts as full if shorter pieces are left to fill the rest. At the end every bin shrinks to the
shortest permitted length that holds its contents.

Pieces of one length are alike, so the packing is worked out on the histogram of lengths: at most as many rows as the longest sequence has
tokens, whatever the number of documents, and the same result as going piece by piece over the whole corpus. It yields rules "of the pieces of this length,
those ranked from a to b go to the bins from c on, t to a bin, at this offset". Ranks come from a sharded count, so that one length held by a third of all
pieces is no hot group; the rules are applied to the pieces in place.

Defined results: null and empty texts are a piece of the end token alone; lengths under one count as one; equal rows are packed as often as
they stand there; an empty table gives no rows; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.llm.common import batches, document_columns, row_key

#: Permitted sequence lengths.
LENGTHS = (512, 1024, 2048, 4096, 8192)


def sequence_cost(length: int) -> float:
    """A fixed part for each sequence, a part for each token and attention over all pairs of tokens."""
    return 64 + length + length * length / 65_536


def pack_histogram(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple], list[tuple]]:
    """Rules (piece length, first rank, last rank + 1, first bin, pieces per bin, offset) and bins (first bin, number, tokens used, permitted length)."""
    lengths = tuple(sorted(lengths))
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> heap of (first bin, number, used)
    rooms: list[int] = []
    rules, next_bin = [], 0
    shorter = [n for n in sorted(counts) if counts[n] > 0]

    def put(first: int, number: int, used: int, room: int) -> None:
        if number:
            if not open_bins.get(room):
                open_bins[room] = []
                bisect.insort(rooms, room)
            heapq.heappush(open_bins[room], (first, number, used))

    def fill(first: int, number: int, used: int, room: int, size: int, rank: int, left: int) -> int:
        """Pieces of one length into bins of one kind, bin after bin; how many were placed."""
        per = room // size
        full, rest = min(number, left // per), 0
        if full:
            rules.append((size, rank, rank + full * per, first, per, used))
            put(first, full, used + per * size, room - per * size)
        if full < number and left > full * per:
            rest = left - full * per
            rules.append((size, rank + full * per, rank + full * per + rest, first + full, rest, used))
            put(first + full, 1, used + rest * size, room - rest * size)
        put(first + full + (rest > 0), number - full - (rest > 0), used, room)
        return full * per + rest

    for size in reversed(shorter):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, number, used = heapq.heappop(open_bins[room])
                if not open_bins[room]:
                    rooms.pop(at)
                done = fill(first, number, used, room, size, rank, left)
            else:
                fits = [n for n in lengths if n >= size]

                def per_token(n: int) -> tuple[float, int]:
                    held = min(n // size, left) * size
                    return cost(n) / (n if n > held and shorter[0] <= n - held and shorter[0] < size else held), n

                chosen, most = min(fits, key=per_token), fits[-1] // size
                per = chosen // size
                number = (left - most) // per + 1 if left >= most else 1
                done = fill(next_bin, number, 0, chosen, size, rank, min(left, number * per))
                next_bin += number
            rank, left = rank + done, left - done
    bins = [(first, number, used, lengths[bisect.bisect_left(lengths, used)]) for heap in open_bins.values() for first, number, used in heap]
    return rules, sorted(bins)


def pieces(docs: DataFrame, n_tokens: Column, longest: int) -> DataFrame:
    """(doc_id, key, piece, start, length): every document cut at the longest sequence."""
    sized = document_columns(docs).withColumn("n", F.greatest(n_tokens.cast("long"), F.lit(1).cast("long"))).select("doc_id", row_key().alias("key"), "n")
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))).alias("piece"))
    return cut.select("doc_id", "key", "piece", (F.col("piece") * longest).alias("start"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).alias("length"))


def word_tokens() -> Column:
    """Words of ``text`` and the end token."""
    return F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def pack(docs: DataFrame, n_tokens: Column | None = None, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost, shard_rows: int = 1 << 20) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, bin_length) of every piece of every document."""
    batches(docs.sparkSession)
    cut = pieces(docs, word_tokens() if n_tokens is None else n_tokens, max(lengths))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules, bins = pack_histogram(counts, lengths, cost)
    if not counts:
        return cut.select("doc_id", "piece", "start", "length", *[F.lit(0).cast("long").alias(c) for c in ("bin_id", "bin_offset", "bin_length")])
    shards = max(16, -(-sum(counts.values()) // shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(shards)))
    per = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = per.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "key", "piece")) - 1
    ranked = dealt.withColumn("inner", inner).join(before, ["length", "shard"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("inner")).alias("rank"))
    rules.sort()
    table = np.array(rules, dtype=np.int64).reshape(-1, 6)
    kinds = np.array(bins, dtype=np.int64).reshape(-1, 4)
    top = int(table[:, 2].max()) + 1

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * top + table[:, 1]
        for p in parts:
            length, rank = p.column(3).to_numpy(), p.column(4).to_numpy()
            rule = table[np.searchsorted(starts, length * top + rank, side="right") - 1]
            inner = rank - rule[:, 1]
            where = rule[:, 3] + inner // rule[:, 4]
            kind = kinds[np.searchsorted(kinds[:, 0], where, side="right") - 1]
            cols = [pa.array(where), pa.array(rule[:, 5] + inner % rule[:, 4] * length), pa.array(kind[:, 3])]
            yield pa.RecordBatch.from_arrays([*p.columns[:4], *cols], ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_length"])

    return ranked.mapInArrow(place, "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_length long")
