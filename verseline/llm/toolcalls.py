"""Tool-call linking for chat data.

Calls and results meet in a hash join on (conversation, call id); calls are put in topological order; arguments are validated against the
schema of their tool; every message, call and result is serialised as canonical JSON (sorted keys, no spaces, UTF-8, whole numbers
without a fraction).

``extract`` reads calls and results from message texts: an object with ``tool_calls`` (a list of id, name, arguments, depends_on) in any
message, and an object with ``tool_call_id`` and ``content`` in a message of role ``tool``. Other messages stay as they are.

Order: a call comes at the turn it stands in; one that depends on a call further down comes right after it (``hop`` counts such moves), and every
result right after its call. Calls out of order are moved by joins over the edges until nothing changes, however long the chain. A call that
depends on itself through others gets status ``cycle``, at its own place; one that merely follows a cycle does not. Sorting by (conv_id, order_turn, order_hop,
call_id, part) gives the order; no conversation is gathered, so one that holds a third of all rows is no hot group.

Status: ``linked``, ``unanswered`` (a call without result), ``orphan`` (a result without call), ``repeated`` (the id was used before in the
conversation: the first call, or result, in turn order is the one that counts), ``cycle``, and ``message``. Defined results: null texts and
roles are empty; JSON that does not parse is text; a null or missing id never links; rows that repeat are repeated calls; null turns come first;
a dependency on an unknown id is ignored; calls of unknown tools are invalid with error ``unknown tool``; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import batches, checkpointed, field

EVENT = "conv_id long, turn long, part string, call_id string, name string, arguments string, content string, depends_on array<string>, seq int"
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: Any) -> str:
    def plain(v: Any) -> Any:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema (type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength) a value breaks."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        allowed = [kinds] if isinstance(kinds, str) else kinds
        fits = any(isinstance(value, KINDS[k]) and (k not in ("integer", "number") or not isinstance(value, bool)) or k == "integer" and isinstance(value, float) and value.is_integer() for k in allowed)
        if not fits:
            return [f"{at}: not {'/'.join(allowed)}"]
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in own:
                out += problems(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{at}[{i}]")
    return out


def _parse(text: str | None) -> Any:
    """The JSON value of a text, or None; numbers that JSON does not know are no JSON."""

    def refuse(_: str) -> None:
        raise ValueError("not JSON")

    try:
        return json.loads(text, parse_constant=refuse) if text and text.lstrip()[:1] in ("{", "[") else None
    except (ValueError, RecursionError):
        return None


def _text(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else canonical(v)


def _events(role: str, text: str) -> list[dict]:
    body = _parse(text)
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        calls = [c for c in body["tool_calls"] if isinstance(c, dict)]
        out = [{"part": "call", "call_id": _text(c.get("id")), "name": _text(c.get("name")), "arguments": _text(c.get("arguments", {})), "depends_on": [_text(d) for d in c.get("depends_on") or [] if d is not None] if isinstance(c.get("depends_on") or [], list) else []} for c in calls]
        return out + ([{"part": "message", "content": _text(body["content"])}] if body.get("content") is not None else [])
    if role == "tool" and isinstance(body, dict) and "tool_call_id" in body:
        return [{"part": "result", "call_id": _text(body["tool_call_id"]), "content": _text(body.get("content"))}]
    return [{"part": "message", "content": text}]


def extract(messages: DataFrame) -> DataFrame:
    """Events of a message table (conv_id, turn, role, text); ``name`` of a message is its role."""
    batches(messages.sparkSession)
    rows = messages.select(field(messages, "conv_id").cast("long").alias("conv_id"), field(messages, "turn").cast("long").alias("turn"), *[F.coalesce(field(messages, c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out = []
            for conv, turn, role, text in zip(*[c.to_pylist() for c in p.columns]):
                for i, e in enumerate(_events(role, text)):
                    out.append({"name": role, "call_id": None, "arguments": None, "content": None, "depends_on": [], **e, "conv_id": conv, "turn": turn, "seq": i})
            if out:
                kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "depends_on": pa.list_(pa.string()), "seq": pa.int32()}
                names = ["conv_id", "turn", "part", "call_id", "name", "arguments", "content", "depends_on", "seq"]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds.get(n, pa.string())) for n in names], names)

    return rows.mapInArrow(run, EVENT)


NODE, PARENT = ["conv_id", "call_id"], ["conv_id", "parent"]


def _as_parent(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("call_id", "parent")


def _turns(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, at) of calls that depend, through others too, on a later turn than their own: the latest such turn."""
    late = edges.groupBy(*NODE).agg(F.max("pt").alias("at"), F.first("t").alias("t")).where("at > t").select(*NODE, "at")
    raised = new = checkpointed(late)
    while not new.isEmpty():
        up = edges.join(_as_parent(new), PARENT).groupBy(*NODE).agg(F.max("at").alias("up"), F.first("t").alias("t"))
        new = checkpointed(up.join(raised, NODE, "left").where(F.col("up") > F.greatest(F.coalesce("at", "t"), "t")).select(*NODE, F.col("up").alias("at")))
        raised = checkpointed(raised.unionByName(new).groupBy(*NODE).agg(F.max("at").alias("at")))
    return raised


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, hop) by the longest path of edges that lead to a call, and the edges never peeled: into cycles and what follows them."""
    hops, hop = edges.select(*NODE, F.lit(0).alias("hop")).where(F.lit(False)), 0
    now = checkpointed(edges.select(*NODE, "parent"))
    n = now.count()
    while n:
        left = checkpointed(now.join(_as_parent(now.select(*NODE).distinct()), PARENT, "left_semi"))
        hop, m = hop + 1, left.count()
        if m == n:
            break
        hops = checkpointed(hops.unionByName(now.join(left, NODE, "left_anti").select(*NODE).distinct().withColumn("hop", F.lit(hop))))
        now, n = left, m
    return hops, now


def _cyclic(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id) of the calls that reach themselves: every call takes the largest id among those it depends on, and those that the
    call of that id depends on in turn, among calls of the same id, are in one cycle with it; the rest goes on without them."""
    found = edges.select(*NODE).where(F.lit(False))
    while not edges.isEmpty():
        own = edges.select(*NODE).unionByName(edges.select("conv_id", F.col("parent").alias("call_id"))).distinct()
        colour, changed = checkpointed(own.withColumn("c", F.col("call_id"))), True
        while changed:
            up = edges.join(_as_parent(colour), PARENT).groupBy(*NODE).agg(F.max("c").alias("up"))
            now = checkpointed(colour.join(up, NODE, "left").select(*NODE, F.greatest("c", F.coalesce("up", "c")).alias("c"), (F.coalesce("up", "c") > F.col("c")).alias("moved")))
            colour, changed = now.drop("moved"), not now.where("moved").isEmpty()
        alike = checkpointed(edges.join(colour, NODE).join(_as_parent(colour).withColumnRenamed("c", "pc"), PARENT).where("c = pc").select(*NODE, "parent"))
        roots = colour.where("c = call_id").select(*NODE)
        on, new = found.where(F.lit(False)), roots
        while not new.isEmpty():
            new = checkpointed(alike.join(new, NODE).select("conv_id", F.col("parent").alias("call_id")).distinct().join(on, NODE, "left_anti"))
            on = checkpointed(on.unionByName(new))
        found, gone = checkpointed(found.unionByName(on)), on.unionByName(roots).distinct()
        edges = checkpointed(edges.join(gone, NODE, "left_anti").join(_as_parent(gone), PARENT, "left_anti").select(*NODE, "parent"))
    return found


def _order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_hop, cycle) of counted calls: a call comes after what it depends on."""
    links = calls.select(*NODE, F.explode(F.array_distinct("depends_on")).alias("parent"))
    place = calls.select(*NODE, F.coalesce("turn", F.lit(-(1 << 62))).alias("t"))
    edges = checkpointed(links.join(_as_parent(place).withColumnRenamed("t", "pt"), PARENT).join(place, NODE).select(*NODE, "parent", "t", "pt"))

    def placed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        raised = _turns(edges)
        at = edges.join(raised, NODE, "left").join(_as_parent(raised).withColumnRenamed("at", "pat"), PARENT, "left")
        # only calls that end up in the turn of one they depend on have to come after it; a cycle holds such edges only
        return (raised, *_peel(at.where(F.coalesce("at", "t") == F.coalesce("pat", "pt"))))

    raised, hops, left = placed(edges)
    cyclic = _cyclic(left)
    if not cyclic.isEmpty():  # these stay at their own places; others come after them
        raised, hops, _ = placed(edges.join(cyclic, NODE, "left_anti"))
    out = place.join(raised, NODE, "left").join(hops, NODE, "left").join(cyclic.withColumn("cycle", F.lit(True)), NODE, "left")
    return out.select(*NODE, F.coalesce("at", "t").alias("order_turn"), F.coalesce("hop", F.lit(0)).alias("order_hop"), F.coalesce("cycle", F.lit(False)).alias("cycle"))


def link(events: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, part, call_id, status, order_turn, order_hop, valid, errors, json) of every event; ``tools``: schema by name."""
    batches(events.sparkSession)
    events = checkpointed(events.withColumn("row", F.monotonically_increasing_id()))
    named = events.where("part <> 'message' and call_id is not null and conv_id is not null")
    # the event of an id that counts: a map-side combined minimum, as one id may be repeated by very many rows
    uses = named.groupBy("conv_id", "part", "call_id").agg(F.min(F.struct("turn", "seq", "arguments", "content", "row"))["row"].alias("row")).select("row", F.lit(True).alias("counts"))
    named = named.join(uses, "row", "left").withColumn("counts", F.coalesce("counts", F.lit(False)))
    calls, results = named.where("part = 'call'"), named.where("part = 'result'")
    counted, answers = checkpointed(calls.where("counts")), results.where("counts")
    order = _order(counted)
    partner = answers.select("conv_id", "call_id", F.lit(True).alias("answered"), F.col("turn").alias("answer_turn"))
    linked_calls = counted.join(partner, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    linked_calls = linked_calls.withColumn("status", F.when(F.coalesce("cycle", F.lit(False)), F.lit("cycle")).when(F.col("answered"), F.lit("linked")).otherwise(F.lit("unanswered")))
    own_turn = F.coalesce("turn", F.lit(-(1 << 62)))
    linked_results = answers.join(order, ["conv_id", "call_id"], "left").withColumn("status", F.when(F.col("order_turn").isNull(), F.lit("orphan")).otherwise(F.lit("linked")))
    rest = named.where("not counts").withColumn("status", F.lit("repeated"))
    loose = events.where("part <> 'message' and (call_id is null or conv_id is null)").withColumn("status", F.when(F.col("part") == "call", F.lit("unanswered")).otherwise(F.lit("orphan")))
    plain = events.where("part = 'message'").withColumn("status", F.lit("message"))
    cols = ["conv_id", "turn", "part", "call_id", "name", "arguments", "content", "status", "seq"]
    ordered = [d.select(*cols, F.coalesce("order_turn", own_turn).alias("order_turn"), F.coalesce("order_hop", F.lit(0)).alias("order_hop")) for d in (linked_calls, linked_results)]
    others = [d.select(*cols, own_turn.alias("order_turn"), F.lit(0).alias("order_hop")) for d in (rest, loose, plain)]
    rows = ordered[0]
    for d in (*ordered[1:], *others):
        rows = rows.unionByName(d)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            valid, errors, texts = [], [], []
            for part, call_id, name, arguments, content in zip(*[p.column(i).to_pylist() for i in (2, 3, 4, 5, 6)]):
                found: list[str] | None = None
                if part == "call":
                    value = _parse(arguments)
                    found = ["unknown tool"] if name not in tools else ["arguments are no JSON"] if value is None else problems(value, tools[name])
                    body = {"arguments": value if value is not None else arguments, "id": call_id, "name": name, "type": "tool_call"}
                elif part == "result":
                    value = _parse(content)
                    body = {"content": value if value is not None else content, "id": call_id, "type": "tool_result"}
                else:
                    body = {"content": content, "role": name, "type": "message"}
                valid.append(None if found is None else not found)
                errors.append(None if found is None else "; ".join(found))
                texts.append(canonical(body))
            keep = [p.column(i) for i in (0, 1, 2, 3, 7, 9, 10)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())], ["conv_id", "turn", "part", "call_id", "status", "order_turn", "order_hop", "valid", "errors", "json"])

    return rows.mapInArrow(run, "conv_id long, turn long, part string, call_id string, status string, order_turn long, order_hop int, valid boolean, errors string, json string")
