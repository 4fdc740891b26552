"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward

from verseline.llm import collocations, multi_index, structure


def counted(docs, longest=4):
    """Per language: all words, and the count of every phrase within pieces."""
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n, f = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    return n, f


def best_phrases(docs, threshold, keep):
    n, f = counted(docs)
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= threshold}
    covered = {(g[0], *g[i:j]) for g, a in cand.items() for i in range(1, len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) - 1 and 100 * a >= 80 * cand[(g[0], *g[i:j])]}
    rows = collections.defaultdict(list)
    for g, a in cand.items():
        if g not in covered:
            cuts = [(2000000 * a // (f[g[: k + 1]] + f[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            rows[g[0]].append((-score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(g[0], *g[k + 1 :])]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:keep], 1))


@pytest.mark.parametrize("capacity", [8, 1 << 16])
def test_collocations_equal_counting(spark, monkeypatch, capacity):
    monkeypatch.setattr(collocations, "SLICE", 200)
    rng = random.Random(4)
    words = ["Ab", "b", "ß", "c\x00d", "e'f", "x" * 300, "日本", "B"]
    docs = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choices(words, weights=[9, 9, 3, 2, 2, 1, 2, 3], k=rng.randint(0, 60))).replace("e'f", rng.choice(["e.f", "e\tf", "e  f", "e\x0bf"]))) for _ in range(150)]
    docs += [("en", "b " * 4000), ("en", None), (None, ""), ("en", "rare words only once")] + [("de", "Ab b ß.")] * 40
    rows = [(i, lang, t, 1, 2, "p") for i, (lang, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n int, size int, phrase string").repartition(7)
    got = sorted(map(tuple, collocations.collocations(df, threshold=12, keep=15, capacity=capacity, bits=12).collect()))
    assert got == best_phrases(docs, 12, 15) and len(got) > 20
    assert collocations.collocations(df.limit(0)).count() == 0


def test_phrases_are_cut_without_a_loop(monkeypatch):
    texts = ["Ab  b\tß. 日本 b", "", ". x", "b b b b b"]
    full = collocations.Bitmap(12, np.full(1 << 6, -1, dtype=np.int64).view(np.uint64))
    part = pa.RecordBatch.from_arrays([pa.array(["en", "de", "und", "en"]), pa.array(texts)], ["lang", "text"])

    def counts():
        got = collections.Counter()
        for out in collocations._exact_counts((1, 2, 3), {1: full, 2: full, 3: full})(iter([part])):
            for *key, n in zip(*[c.to_pylist() for c in out.columns]):
                got[tuple(key)] += n
        return got

    monkeypatch.setattr(collocations.Words, "phrase", None)  # one text at a time
    want = {("en", 0, ""): 10, ("und", 0, ""): 1, ("en", 1, "ab"): 1, ("en", 1, "b"): 7, ("en", 1, "ß"): 1, ("en", 1, "日本"): 1, ("und", 1, "x"): 1}
    want |= {("en", 2, "ab b"): 1, ("en", 2, "b ß"): 1, ("en", 2, "日本 b"): 1, ("en", 2, "b b"): 4, ("en", 3, "ab b ß"): 1, ("en", 3, "b b b"): 3}
    assert counts() == want


def test_collocations_of_tables_without_words(spark):
    df = awkward(spark).selectExpr("*", "cast(null as string) lang")
    assert collocations.collocations(df).count() == 0


def test_summaries_keep_every_frequent_hash():
    rng = np.random.default_rng(1)
    for seed in range(20):
        stream = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat(rng.integers(0, 5000, 30), 30), np.full(rng.integers(1, 9000), 7)]).astype(np.uint64)
        rng.shuffle(stream)
        s = collocations.Summary(capacity=len(stream) // 30 + 1, threshold=30)
        for part in np.array_split(stream, 37):
            s.merge(*np.unique(part, return_counts=True))
        h, n = np.unique(stream, return_counts=True)
        assert set(h[n >= 30]) <= set(s.survivors()) and s.taken < 30
        assert len(s.h) <= s.capacity and (seed or s.taken)


def all_audits(rows):
    """Least (cost, audit) by a plain dynamic program over (place, state), with whole strings; rows: (initial, kind)."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    inf = (10**9, "~")
    at = {"": (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(2 * len(rows) + 3):  # inserts
            for s, (c, a) in list(at.items()):
                for x in "ua":
                    if (s, x) in steps:
                        at[steps[s, x]] = min(at.get(steps[s, x], inf), (c + 2, a + "I"))
        if i == len(rows):
            break
        c0, kind = rows[i]
        new = {}

        def put(s, label, new=new):
            new[s] = min(new.get(s, inf), label)

        for s, (c, a) in at.items():
            put(s, (c + 3, a + "D"))
            if kind != "b":
                more = kind == "t"
                if (s, c0) in steps:
                    put(steps[s, c0], (c + more, a + "K"))
                for x in "ua":
                    if (s, x) in steps:
                        put(steps[s, x], (c + 2 + more, a + "R"))
        at = new
    return min(at[s] for s in ("", "a") if s in at)


def test_search_from_both_ends_equals_a_dynamic_program():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice("suuaaax"), rng.choice(["", "", "b", "t"])) for _ in range(rng.randint(0, 9))]
        assert structure.cheapest(tuple((c, k, 1) for c, k in rows), structure.START, structure.ENDS) == all_audits(rows), rows


def repaired_by_hand(table):
    """The contract of operator 13, conversation by conversation."""
    rows = collections.defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        own = rows[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        if fault:
            own += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text)] * (2 if fault == 3 else 1)
    out = []
    for conv, own in rows.items():
        own.sort()
        turns = [t for known, t, *_ in own if known]
        kinds, seen = [], set()
        for _, _, role, _, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = all_audits([(r[2][:1], {"blank": "b", "duplicate": "b", "truncated": "t", "": ""}[k]) for r, k in zip(own, kinds)])
        lines, left = [], iter(own)
        for letter in audit:
            r = next(left) if letter != "I" else None
            if letter == "D":
                continue
            role = r[2] if letter == "K" else "assistant" if lines and lines[-1].startswith("u") else "user"
            lines.append(f"{role}:{'' if r is None else r[4]}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return out


@pytest.mark.parametrize("block", [3, 512])
def test_structure_repair_equals_the_contract(spark, block):
    rng = random.Random(block)
    said = ["Yes.", "No", "Why?", "", " \x0b", "Ünd so!", "a" * 5000 + ".", None, "Yes.\n", "\x0cYes"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(said)) for c in [*range(60), None] for t in rng.sample([None, *range(-2, 12)], rng.randint(1, 9))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Line {t % 400}.") for t in range(1200)]  # one conversation holds most of the rows
    rows += [(901, 5, "user", "Same.")] * 30 + [(902, None, "user", "x"), (902, None, "assistant", "y"), (903, None, None, None), (904, 2**60 + 1, "user", "Hi."), (904, 2**60, "user", "Hi.")]
    rows += [(c, 0, "user", "Hi.") for c in range(2000, 2060)]  # some lose their only row
    df = spark.createDataFrame([(*r, "k", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key string, n int, audit string").repartition(9)
    got = sorted(map(tuple, structure.digests(structure.repair(structure.damaged(df), block=block), df).collect()), key=repr)
    assert got == sorted(repaired_by_hand(rows), key=repr)


def test_structure_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.digests(structure.repair(structure.damaged(df)), df).count() == 0


def nearest_by_hand(rows, k):
    """Exact answer of operator 11: rows of (vec_id, vector)."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = []
    for i, v in rows:
        if i % 50 == 0:
            own = sorted((-float(multi_index.cosine(np.array([v]), np.array([w]))[0]), j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(own[:k], 1)]
    return sorted(out)


def test_nearest_equals_brute_force_when_all_neighbours_are_aimed_at(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 7))
    rows = [(i, (centres[i % 6] + rng.normal(size=7) * 0.2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(50, rows[50][1]), (100, rows[7][1]), (7, rows[7][1])]
    rows += [(2000, [1.0]), (2001, [-3.0]), (2050, [2.0, 0.0]), (2002, [4.0, 1e-300]), (2051, [1e300, 1e300])]
    rows += [(None, [1.0] * 7), (2100, None), (2150, [0.0] * 7), (2200, [float("nan")] * 7), (2250, [None] + [1.0] * 6), (2300, [float("inf")] * 7), (2350, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, query_id int, v string, score double").repartition(5)
    vectors = multi_index.vectors_of(df)
    got = multi_index.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, recall=1.0, sample=150, entry_block=64, query_block=3).collect()
    assert sorted(map(tuple, got)) == nearest_by_hand(rows, 5)
    none = multi_index.vectors_of(df.limit(0))
    assert multi_index.search(none, none).count() == 0


def test_nearest_meets_its_recall(spark):
    vectors = multi_index.vectors_of(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = [(r.vec_id, r.v) for r in vectors.collect()]
    got = {(r.query_id, r.vec_id) for r in multi_index.search(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    want = {(int(i), int(ids[j])) for i, v in zip(ids, x) if i % 50 == 0 for j in sorted(np.nonzero(ids != i)[0], key=lambda j, v=v: -float(v @ x[j]))[:5]}
    assert len(want & got) >= 0.9 * len(want)


def test_walk_meets_cells_by_their_distance():
    rng = np.random.default_rng(3)
    index = multi_index.MultiIndex(rng.normal(size=(400, 9)), 16)
    for q in rng.normal(size=(20, 9)):
        unit = q / np.linalg.norm(q)
        sums = [float(index.books[0].distances(unit[: index.cut])[i] + index.books[1].distances(unit[index.cut :])[j]) for i, j in index.walk(q)]
        assert len(sums) == 256 and sums == sorted(sums)
