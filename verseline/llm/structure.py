"""Repair of the turn structure of conversations by a bidirectional Dijkstra search over the edit lattice.

A conversation's role initials shall read ``(s?(ua)+)?``. Edits of its rows, in order: K keeps a row (0), R sets its role to user or assistant
(2), D deletes it (3; required for blank and duplicate rows), I inserts a row of empty text (2, anywhere); a truncated row that is not deleted
adds 1. The lattice has a node for every place between rows and every state of the pattern. Two heaps search it, one from the start and one
backwards from the ends; once the sum of their least costs passes the best crossing, all crossings of that cost are known, and the audit (the
edits' initials, forward part and reverse part concatenated) that is least in ASCII wins. An audit fixes the repaired rows: the pattern leaves
one role for every R and I.

Rows are ordered by turn (nulls first), then by role and text. They are sorted by range over all tasks, not gathered by conversation. A task
cuts its rows into pieces of one conversation and at most ``block`` rows; a piece that is a whole conversation is repaired where it lies. The
other pieces get a lattice for every pair of entry and exit state; what travels on are these costs and audits, which are chained along the
conversation, and then each piece writes its repaired rows, which pass in order through the hash of their conversation. One conversation may so
hold any share of all rows: its texts are only ever streamed. Its audit and its hash are one string each, built by the task that returns them.

Defined results: null roles and texts count as one space; a null conv_id is a conversation of its own; equal rows count as often as they
occur, all after the first as duplicates; rows of one turn with different texts are ordered by role and text; a role of another initial than
s, u, a (or an empty one) can not be kept; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, checkpointed, field, null_safe

#: The states of the pattern (nothing yet, s, .. u, .. a), where a role leads, and where it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")


def messages_of(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), null roles and texts as one space."""
    space = F.lit(" ")
    return table.select(
        field(table, "conv_id").cast("long").alias("conv_id"), field(table, "turn").cast("long").alias("turn"),
        F.coalesce(field(table, "role").cast("string"), space).alias("role"), F.coalesce(field(table, "text").cast("string"), space).alias("text"),
    )


def damaged(table: DataFrame) -> DataFrame:
    """The rows with one in four damaged, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out of
    it, 3 repeats it, 4 makes it the user's."""
    rows = messages_of(table)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _forward(rows: tuple, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges from a node: (place, state, cost, letters). A row is (initial, kind, copies); kind b: must be deleted, t: truncated, else whole."""
    for c in "ua":
        to = STEPS.get((state, c))
        if to is not None:
            yield i, to, INSERT, "I"
    if i < len(rows):
        c, kind, copies = rows[i]
        yield i + 1, state, DELETE * copies, "D" * copies
        if kind != "b":
            more = TRUNCATED if kind == "t" else 0
            if (state, c) in STEPS:
                yield i + 1, STEPS[state, c], more, "K"
            for r in "ua":
                to = STEPS.get((state, r))
                if to is not None:
                    yield i + 1, to, REROLE + more, "R"


def _backward(rows: tuple, i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """The same edges into a node."""
    for (s, c), to in STEPS.items():
        if to == state and c != "s":
            yield i, s, INSERT, "I"
    if i:
        c, kind, copies = rows[i - 1]
        yield i - 1, state, DELETE * copies, "D" * copies
        if kind != "b":
            more = TRUNCATED if kind == "t" else 0
            for (s, r), to in STEPS.items():
                if to == state:
                    if r == c:
                        yield i - 1, s, more, "K"
                    if r != "s":
                        yield i - 1, s, REROLE + more, "R"


def cheapest(rows: tuple, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from the entry state to one of the exit states."""
    # Equal costs are settled along the rows (keeping costs nothing and moves one row on), so that the first time a node comes off a heap
    # its audit is the least of its cost.
    done: list[dict] = [{}, {}]
    heaps: list[list] = [[(0, 0, "", entry)], [(0, 0, "", x) for x in exits]]
    heapq.heapify(heaps[1])
    best, n = float("inf"), len(rows)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, place, audit, state = heapq.heappop(heaps[side])
        i = place if side == 0 else n - place
        if (i, state) in done[side]:
            continue
        done[side][i, state] = cost, audit
        if (i, state) in done[1 - side]:
            best = min(best, cost + done[1 - side][i, state][0])
        for j, to, more, letters in (_backward if side else _forward)(rows, i, state):
            if (j, to) in done[1 - side]:
                best = min(best, cost + more + done[1 - side][j, to][0])
            if (j, to) not in done[side]:
                heapq.heappush(heaps[side], (cost + more, n - j if side else j, letters + audit if side else audit + letters, to))
    if best == float("inf"):
        return None
    found = []
    for (i, state), (cost, audit) in done[0].items():
        if cost <= best:
            ends = [(i, state, 0, ""), *_forward(rows, i, state)]
            for j, to, more, letters in ends:
                if (j, to) in done[1] and cost + more + done[1][j, to][0] == best:
                    found.append(audit + letters + done[1][j, to][1])
    return int(best), min(found)


_remembered = lru_cache(maxsize=50_000)(cheapest)


def solve(rows: tuple, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """``cheapest``, with the short patterns that occur again and again remembered."""
    return (_remembered if len(rows) <= 32 else cheapest)(rows, entry, exits)


def repaired(messages: Iterable[tuple[str, str]], audit: str, entry: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave."""
    state, rows = entry, iter(messages)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = STEPS[state, role[:1]]
        yield role, text


class Piece:
    """Neighbouring rows of one conversation, in order: (turn, role, text, first, copies); first: not seen before."""

    def __init__(self, conv_id, opened: bool):
        self.conv_id, self.opened, self.rows, self.size = conv_id, opened, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[2]) + 64

    def summary(self) -> dict:
        """Counts, and the rows as the lattice sees them."""
        cells, out = [], dict(blank=0, duplicate=0, truncated=0, illegal=0)
        before, turns = None, []
        for turn, role, text, first, n in self.rows:
            c, seen = role[:1], text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            out["illegal"] += (before is not None and before + c not in LEGAL) + (n - 1) * (c + c not in LEGAL)
            before = c
            if turn is not None and turn not in turns[-1:]:
                turns.append(turn)
            if not seen:
                out["blank"] += n
                cells.append((c, "b", n))
                continue
            out["duplicate"] += n - first
            if first:
                cut = seen[-1] not in ".!?"
                out["truncated"] += cut
                cells.append((c, "t" if cut else "", 1))
            if n > first:
                cells.append((c, "b", n - first))
        return out | dict(cells=tuple(cells), head=self.rows[0][1][:1], tail=before, turns=len(turns), low=turns[0] if turns else None, high=turns[-1] if turns else None)

    def closed(self, ended: bool) -> dict:
        """The piece's row: solved if it is a whole conversation, else with a way for every pair of states."""
        s = self.summary()
        cells = s.pop("cells")
        out = s | dict(conv_id=self.conv_id, cost=None, audit=None, ways=None)
        if self.opened and ended:
            out["cost"], out["audit"] = solve(cells, START, ENDS)
            out["messages"] = _texts(self.rows, out["audit"], START)
            return out
        ways = [(e, x, solve(cells, e, (x,))) for e in ((START,) if self.opened else range(4)) for x in range(4)]
        out["ways"] = [{"entry": e, "exit": x, "cost": way[0], "audit": way[1]} for e, x, way in ways if way is not None]
        out["messages"] = [{"role": r[1], "text": r[2], "copies": r[4]} for r in self.rows]
        return out


def _texts(rows: list[tuple], audit: str, entry: int) -> list[dict]:
    each = ((r[1], r[2]) for r in rows for _ in range(r[4]))
    return [{"role": role, "text": text, "copies": 1} for role, text in repaired(each, audit, entry)]


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
#: Fields of a piece; the pieces of a conversation follow each other by (part, seq).
PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("head", pa.string()), ("tail", pa.string()),
    ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
])


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in parts:
        for lo in range(0, b.num_rows, 500):
            yield from b.slice(lo, 500).to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += size(r)
        if weight >= 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _weight(r: dict) -> int:
    return 256 + sum(len(m["text"]) + 32 for m in r["messages"])


def _cut(block: int, most: int):
    """For mapInArrow over sorted rows: pieces of at most ``block`` rows and about ``most`` characters."""

    def pieces(parts):
        from pyspark import TaskContext

        now, seq, part = None, 0, TaskContext.get().partitionId()
        for r in _rows(parts):
            new = now is None or now.conv_id != r["conv_id"]
            if now is not None and (new or len(now.rows) >= block or now.size >= most):
                seq += 1
                yield now.closed(new) | dict(part=part, seq=seq)
                now = Piece(r["conv_id"], new)
            elif now is None:
                now = Piece(r["conv_id"], False)  # the first conversation of a task may have begun in an earlier one
            now.add((r["turn"], r["role"], r["text"], r["first"], r["n"]))
        if now is not None:
            yield now.closed(False) | dict(part=part, seq=seq + 1)

    return lambda parts: _batched(pieces(parts), PIECE, _weight)


CHOICE = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("entry", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _runs(rows: Iterator[dict]) -> Iterator[Iterator[dict]]:
    """The rows of each conversation, of rows in order."""
    from itertools import groupby

    for _, own in groupby(rows, key=lambda r: r["conv_id"]):
        yield own


def _chain(parts):
    """For mapInArrow over pieces with ways, in order: the way of every piece on the conversation's cheapest path."""

    def choices():
        for own in _runs(_rows(parts)):
            # state -> (cost, audit so far, ways taken, latest first)
            paths = {START: (0, "", None)}
            for r in own:
                new = {}
                for w in r["ways"]:
                    if w["entry"] in paths:
                        cost, audit, before = paths[w["entry"]]
                        label = (cost + w["cost"], audit + w["audit"])
                        if w["exit"] not in new or label < new[w["exit"]][:2]:
                            new[w["exit"]] = (*label, (r["part"], r["seq"], w, before))
                paths = new
            way = min(paths[x] for x in ENDS if x in paths)[2] if any(x in paths for x in ENDS) else None
            while way is not None:
                part, seq, w, way = way
                yield dict(part=part, seq=seq, entry=w["entry"], cost=w["cost"], audit=w["audit"])

    return _batched(choices(), CHOICE, lambda r: 64 + len(r["audit"]))


def _applied(parts):
    """For mapInArrow over pieces with their choice: the repaired texts in place of the rows."""
    for b in parts:
        rows = b.to_pylist()
        for r in rows:
            r["messages"] = _texts([(None, m["role"], m["text"], True, m["copies"]) for m in r["messages"]], r["audit"], r.pop("entry"))
        yield pa.RecordBatch.from_pylist(rows, PIECE)


def repair(messages: DataFrame, block: int = 512, most: int = 1 << 20) -> DataFrame:
    """Repaired conversations in pieces: (conv_id, part, seq, counts of faults, audit, cost, messages), in order by (part, seq).

    ``messages`` (role, text) of a piece are its repaired rows; audits and costs of a conversation's pieces add up to its own.
    """
    batches(messages.sparkSession)
    rows = messages_of(messages).withColumn("key", F.sha2("text", 256))
    counted = rows.groupBy("conv_id", "turn", "role", "key", "text").agg(F.count("*").alias("n"))
    seen = checkpointed(rows.groupBy("conv_id", "role", "key").agg(F.min("turn").alias("earliest"), F.max(F.col("turn").isNull()).alias("untimed")))
    known = null_safe(counted, seen, ["conv_id", "role", "key"], "inner").withColumn("first", F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("earliest")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "key")]
    sorted_ = known.select("conv_id", "turn", "role", "key", "text", "first", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ", ".join(f"{f.name} {_ddl(f.type)}" for f in PIECE)
    pieces = checkpointed(sorted_.mapInArrow(_cut(block, most), kind))

    split = pieces.where("audit is null")
    place = ["conv_id", "part", "seq"]
    choice = split.select("conv_id", "part", "seq", "ways").repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_chain, "part int, seq long, entry int, cost long, audit string")
    joined = split.drop("cost", "audit").join(choice, ["part", "seq"]).select(*[f.name for f in PIECE], "entry")
    whole = pieces.where("audit is not null").unionByName(joined.mapInArrow(_applied, kind))
    return whole.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))).drop("ways")


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in kind) + ">"
    return {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string"}[kind]


DIGEST = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(parts):
    """For mapInArrow over repaired pieces in order: one row per conversation."""

    def rows():
        for own in _runs(_rows(parts)):
            out, audit, h, tail, low, high, turns, any_line = dict.fromkeys([*COUNTS, "cost"], 0), [], hashlib.sha256(), None, None, None, 0, False
            for r in own:
                for c in [*COUNTS, "cost"]:
                    out[c] += r[c]
                out["illegal"] += tail is not None and tail + r["head"] not in LEGAL
                tail = r["tail"]
                if r["low"] is not None:
                    turns += r["turns"] - (r["low"] == high)
                    low, high = r["low"] if low is None else low, r["high"]
                audit.append(r["audit"])
                for m in r["messages"]:
                    h.update((("\n" if any_line else "") + m["role"] + ":" + m["text"]).encode("utf-8", "surrogatepass"))
                    any_line = True
            yield out | dict(conv_id=r["conv_id"], gaps=0 if low is None else high - low + 1 - turns, audit="".join(audit), repaired_sha256=h.hexdigest())

    return _batched(rows(), DIGEST, lambda r: 256 + len(r["audit"]))


def digests(pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: its counts, cost, audit and the hash of its repaired lines."""
    found = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digests, ", ".join(f"{f.name} {_ddl(f.type)}" for f in DIGEST))
    ids = conversations.select(field(conversations, "conv_id").cast("long").alias("conv_id")).distinct()
    rows = null_safe(ids, found, ["conv_id"], "left")
    return rows.na.fill(0, ["gaps", *COUNTS, "cost"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
