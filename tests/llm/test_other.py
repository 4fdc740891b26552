"""Operators 5, 7 and 10, the pipeline, and what is registered."""

import collections
import json
import random

import numpy as np
import pytest
from helpers import SF, awkward, ordered, pairs

import __spark_entry__ as entry
import corpus_pipeline
from verseline.llm import decontaminate, packing, secrets, simhash, toolcalls, topk, toxicity


def piece_by_piece(counts, lengths, cost):
    """Best-fit decreasing over single pieces."""
    lengths, bins, out, left = sorted(lengths), [], [], collections.Counter(counts)
    least = min((n for n in counts if counts[n]), default=0)
    for n in [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]:
        room = [(b[0] - b[1], i) for i, b in enumerate(bins) if b[0] - b[1] >= n]
        if room:
            i = min(room)[1]
        else:

            def per_token(c, n=n):
                held = min(c // n, left[n]) * n
                return cost(c) / (c if c > held and least <= c - held and least < n else held), c

            bins.append([min([c for c in lengths if c >= n], key=per_token), 0])
            i = len(bins) - 1
        out.append((n, i, bins[i][1]))
        bins[i][1] += n
        left[n] -= 1
    return sorted(out), [(b[1], min(c for c in lengths if c >= b[1])) for b in bins]


@pytest.mark.parametrize("seed", range(60))
def test_packing_the_histogram_is_packing_the_pieces(seed):
    random.seed(seed)
    lengths = sorted(random.sample(range(5, 60), random.randint(1, 4)))
    counts = {random.randint(1, lengths[-1]): random.randint(1, 25) for _ in range(random.randint(1, 12))}
    cost = random.choice([packing.sequence_cost, lambda n: n, lambda n: 5 + n, lambda n: n * n])
    rules, bins = packing.pack_histogram(counts, tuple(lengths), cost)
    got = sorted((n, b + k // per, off + k % per * n) for n, a, z, b, per, off in rules for k in range(z - a))
    want, sizes = piece_by_piece(counts, lengths, cost)
    assert got == want
    own = {b + k: (used, size) for b, number, used, size in bins for k in range(number)}
    assert [own[i] for i in range(len(own))] == sizes


def test_packing_places_every_piece_once(spark):
    docs = awkward(spark, [(9, "w " * 1000), (9, "w " * 1000), (10, "v " * 99)])
    rows = packing.pack(docs, lengths=(16, 64, 100)).collect()
    tokens = sorted(len((t or "").split()) + 1 for _, t in pairs(docs))
    assert sum(r.length for r in rows) == sum(tokens) and len(rows) == sum(-(-n // 100) for n in tokens)
    by_bin = collections.defaultdict(list)
    for r in rows:
        by_bin[r.bin_id].append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        used = sum(r.length for r in own)
        assert {r.bin_length for r in own} == {min(n for n in (16, 64, 100) if n >= used)}
    assert sorted(by_bin) == list(range(len(by_bin)))
    assert packing.pack(docs.limit(0)).count() == 0


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c)) for c in calls]})


def result(name, value):
    return json.dumps({"tool_call_id": name, "content": value})


def test_tool_calls_link_order_and_validate(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "f", {"x": 1.0, "é": 2}, ["c"]), ("b", "f", {"x": "1"}, []))), (1, 2, "tool", result("a", {"z": 1, "b": [1.50]})),
        (1, 3, "assistant", call(("c", "g", {}, ["b"]), ("a", "f", {"x": 2}, []))), (1, 4, "tool", result("c", None)), (1, 4, "tool", result("q", "lost")),
        (1, 5, "assistant", call(("d", "f", '{"x":3}', ["e"]), ("e", "f", "{x", ["d"]), (None, "f", {"x": 1}, None))),
        (2, None, None, None), (None, 1, "tool", result("a", 1)), (3, 0, "x", '{"tool_calls":3}'), (4, 0, "a", "[NaN]"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    tools = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    got = toolcalls.link(toolcalls.extract(df), tools).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_hop, r.call_id or "", r.part))
    state = [(r.part, r.call_id, r.status) for r in one]
    assert state.index(("call", "a", "linked")) > state.index(("call", "c", "linked")) > state.index(("call", "b", "unanswered"))
    assert state.index(("result", "a", "linked")) == state.index(("call", "a", "linked")) + 1
    assert ("call", "a", "repeated") in state and ("result", "q", "orphan") in state and ("call", "d", "cycle") in state and ("call", "e", "cycle") in state
    errors = {(r.call_id, r.status): r.errors for r in one if r.part == "call"}
    assert errors["a", "linked"] == "" and errors["b", "unanswered"] == "$.x: not integer" and errors["c", "linked"] == "unknown tool" and errors["e", "cycle"] == "arguments are no JSON"
    texts = {(r.part, r.call_id, r.status): r.json for r in one}
    assert texts["call", "a", "linked"] == '{"arguments":{"x":1,"é":2},"id":"a","name":"f","type":"tool_call"}'
    assert texts["result", "a", "linked"] == '{"content":{"b":[1.5],"z":1},"id":"a","type":"tool_result"}'
    assert len(got) == 15 and {r.status for r in got if r.conv_id in (2, 3, 4)} == {"message"}
    assert toolcalls.link(toolcalls.extract(df.limit(0)), tools).count() == 0


def test_long_chains_are_ordered_and_only_cycles_are_cycles(spark):
    chain = call(*[(f"c{i:02}", "f", {}, [f"c{i - 1:02}"] if i else []) for i in reversed(range(40))])
    later = [(2, i, "assistant", call((f"p{i}", "f", {}, [f"p{i + 1}"]))) for i in range(4)]
    knot = [("a", "f", {}, ["b"]), ("b", "f", {}, ["a"]), ("m", "f", {}, ["b"]), ("x", "f", {}, ["m", "y"]), ("y", "f", {}, ["x"]), ("z", "f", {}, ["y"]), ("s", "f", {}, ["s"]), ("u", "f", {}, ["z", "s"])]
    df = spark.createDataFrame([(1, 3, "assistant", chain), *later, (3, 1, "assistant", call(*knot))], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): (r.status, r.order_turn, r.order_hop) for r in toolcalls.link(toolcalls.extract(df), {}).collect()}
    assert [got[1, f"c{i:02}"] for i in range(40)] == [("unanswered", 3, i) for i in range(40)]
    assert [got[2, f"p{i}"] for i in range(4)] == [("unanswered", 3, 3 - i) for i in range(4)]
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {**{c: ("cycle", 1, 0) for c in "abxys"}, "m": ("unanswered", 1, 1), "z": ("unanswered", 1, 1), "u": ("unanswered", 1, 2)}


def test_conversation_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = {(r.conv_id, r.turn): r for r in rows}
    want = collections.Counter()
    for r in rows:
        other = turns.get((r.conv_id, r.turn + 1 if r.role == "user" else r.turn - 1))
        if r.role == "user":
            body = {"arguments": {"question": r.text, "turn": r.turn}, "id": f"{r.conv_id}:{r.turn}", "name": "answer", "type": "tool_call"}
            want["call", r.conv_id, r.turn, "linked" if other and other.role == "assistant" else "unanswered", toolcalls.canonical(body)] += 1
        elif r.role == "assistant":
            body = {"content": r.text, "id": f"{r.conv_id}:{r.turn - 1}", "type": "tool_result"}
            want["result", r.conv_id, r.turn, "linked" if other and other.role == "user" else "orphan", toolcalls.canonical(body)] += 1
        else:
            want["message", r.conv_id, r.turn, "message", toolcalls.canonical({"content": r.text, "role": r.role, "type": "message"})] += 1
    got = collections.Counter((r.part, r.conv_id, r.turn, r.status, r.json) for r in entry.queries()["op7_tool_calls"](spark, SF).collect())
    assert got == want


def test_schema_problems():
    schema = {"type": "object", "properties": {"n": {"type": "number", "minimum": 1, "maximum": 2}, "s": {"enum": ["a", 1]}, "l": {"type": "array", "items": {"type": ["string", "null"]}}}, "additionalProperties": False}
    assert toolcalls.problems({"n": 1.5, "s": 1.0, "l": ["x", None]}, schema) == []
    assert toolcalls.problems({"n": True, "s": "b", "l": [3], "z": 1}, schema) == ["$.l[0]: not string/null", "$.n: not number", "$.s: not in enum", "$.z: not allowed"]


@pytest.mark.parametrize("shard_rows, block", [(20_000, 4096), (90, 3)])
def test_top_k_matches_brute_force(spark, shard_rows, block):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = topk.quantised(df)
    got = ordered(map(tuple, topk.search(v, v.where("vec_id % 50 = 0"), shard_rows=shard_rows, block=block).collect()))
    p = df.toPandas()
    x, ids = np.floor(256 * np.stack([np.array(e, dtype=float) for e in p.embedding])).astype(np.int64), p.vec_id.to_numpy()
    want = []
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:5]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)]
    assert got == ordered(want)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (50, [1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (100, []), (6, []), (None, [1.0, 1.0]), (150, [3e6, -3e6]), (7, [3e6, 3e6]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    v = topk.quantised(df)
    got = collections.defaultdict(list)
    for r in topk.search(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(7, 589824000000), (4, 327680), (5, 327680), (150, -196608000000)] and got[100] == [(6, 0)] and 50 not in got
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_pipeline_stages_do_their_work(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    now = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("toxic", "copies", "benchmark", "secrets", "packing")):
        before, after = now, stage(spark, now, sf).cache()
        texts = dict(pairs(before))
        if check == "toxic":
            bad = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
            assert bad and {r.doc_id for r in after.collect()} == set(texts) - bad
        elif check == "copies":
            own = {i: decontaminate._shingles(decontaminate.words_of(t)) for i, t in texts.items()}
            kept = {r.doc_id for r in after.collect()}
            assert len({t for i, t in texts.items() if i in kept}) == len(kept) and set(t for t in texts.values()) >= {texts[i] for i in kept}
            for i in set(own) - kept:  # whatever went has a close partner that stays or went with it
                assert any(texts[j] == texts[i] or own[i] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) for j in own if j != i)
            for i in kept:
                assert not any(own[i] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) for j in kept if j < i)
        elif check == "benchmark":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            bad = {r.doc_id for r in decontaminate.search(before, bench).collect()}
            assert {r.doc_id for r in after.collect()} == set(texts) - bad
        elif check == "secrets":
            assert {r.doc_id for r in after.collect()} == set(texts)
            assert secrets.scan(after).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert {r.doc_id for r in after.collect()} == set(texts)
            break
        assert after.columns == docs.columns
        now = after


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert simhash.WORD_TAU == 4
