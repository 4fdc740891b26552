"""Operators 1 and 4 against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import SF, awkward, ordered, pairs

from verseline.llm import components, simhash, suffix_dedup


def repeated(rows, n=200):
    seen = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[j : j + n] for j in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def passages():
    random.seed(3)
    shared = "".join(random.choice("abcdefgh é") for _ in range(900))
    rows = [(10, "a" * 1000), (11, "ab" * 500), (None, shared), (4, shared), (4, shared), (12, "b" * 199), (13, "b" * 200)]
    for i in range(20, 70):
        a, own = random.randint(0, 400), [random.choice("abcdefgh") for _ in range(random.randint(0, 300))]
        body = own + list(shared[a : a + random.randint(150, 500)]) + own[::-1]
        if i % 3 == 0:
            body[random.randrange(len(body))] = "Z"
        rows.append((i, "".join(body)))
    return rows


@pytest.mark.parametrize("bucket", [50_000, 3])
def test_suffix_dedup_matches_brute_force(spark, bucket):
    """With a bucket of 3 nearly all contexts take the counted way."""
    docs = awkward(spark, passages())
    got = suffix_dedup.dedup(docs, bucket=bucket).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == repeated(pairs(docs))
    assert suffix_dedup.dedup(docs.limit(0), bucket=bucket).count() == 0


def test_suffix_dedup_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == repeated(pairs(docs))


def test_interval_tree_is_complete():
    """Intervals of a common-prefix array against all pairs of rows."""
    random.seed(5)
    for _ in range(50):
        rows = sorted("".join(random.choice("ab") for _ in range(8)) for _ in range(12))
        common = [0] + [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(rows, rows[1:])]
        got = set(suffix_dedup.intervals(common, 1))
        want = set()
        for i in range(12):
            for j in range(i + 1, 12):
                depth = min(common[i + 1 : j + 1])
                lo = max(k for k in range(i + 1) if k == 0 or common[k] < depth)
                hi = min([k - 1 for k in range(j + 1, 12) if common[k] < depth] + [11])
                if depth >= 1:
                    want.add((depth, lo, hi))
        assert got == want


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    own = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    votes = [0] * 64
    for s in own:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(own))


def closure(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_rows(spark):
    docs = awkward(spark, [(7, "ONE two\tthree"), (8, "Ünïcode É two three four five six"), (9, "ünïcode É two three four five six")])
    rows = pairs(docs)
    fps = [fingerprint(t) for _, t in rows]
    group = closure(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    ids = {g: min([i for (i, _), h in zip(rows, group) if h == g and i is not None], default=None) for g in group}
    want = [(i, f, ids[g]) for (i, _), f, g in zip(rows, fps, group)]
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_components(simhash.fingerprints(docs)).collect()]
    assert ordered(got) == ordered(want)
    assert simhash.near_components(simhash.fingerprints(docs.limit(0))).count() == 0


@pytest.mark.parametrize("tau", [0, 2, 3])
def test_links_lose_nothing(spark, tau, monkeypatch):
    """Clusters around a few centres with tiny buckets, so that buckets are split again and again."""
    random.seed(tau)
    centres, values = [random.getrandbits(64) for _ in range(3)], []
    for _ in range(700):
        v = random.choice(centres)
        for _ in range(random.randint(0, 5)):
            v ^= 1 << random.randrange(64)
        values.append(v)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, tau: links(nodes, tau, bucket=15))
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, tau).collect()}
    want = closure(values, lambda a, b: (a ^ b).bit_count() <= tau)
    assert got == dict(enumerate(want))


def test_thresholds_cover_the_pigeonhole():
    """Any two fingerprints within tau bits agree on some mask of the plan."""
    rng, tau = np.random.default_rng(1), 3
    groups = simhash.group_bits(10, rng.random((64, 64)) * 5, 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    _, units = simhash.allocate([len(g) for g in groups], [[0.5, 0.01, 0.2, 0.9]] * 5, 1000, tau)
    assert sum(units) == tau + 1
    masks = [m for g, u in zip(groups, units) if u for m in simhash._masks(0, g, u)]
    for _ in range(2000):
        flips = rng.choice(64, size=tau, replace=False)
        assert any(not m & sum(1 << int(b) for b in flips) for m in masks)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (103, 101), (102, 103)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 101: 101, 102: 101, 103: 101}


def test_near_duplicates_keep_one(spark):
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]  # as in natural text, a few words are frequent
    base = [random.choices(vocabulary, weights, k=300) for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((100 * k, " ".join(words)))
        for c in range(1, 6):
            copy = list(words)
            for _ in range(c - 1):
                copy[random.randrange(300)] = random.choices(vocabulary, weights)[0]
            rows.append((100 * k + c, " ".join(copy)))
    docs = awkward(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None and (r.doc_id % 100 == 0 or r.doc_id > 3)]
    assert sorted(ids) == [100 * k for k in range(12)]
    assert sorted(r.doc_id for r in kept.collect() if (r.doc_id or 0) in (1, 2)) == [1, 2]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def edited(shape, words, share, fresh):
    """A copy with that share of words appended, cut at the end, or replaced here and there."""
    n = int(len(words) * share)
    if shape == "appended":
        return words + [next(fresh) for _ in range(n)]
    if shape == "cut":
        return words[: len(words) - n]
    copy = list(words)
    for i in random.sample(range(len(words)), max(1, n // 9)):
        copy[i] = next(fresh)
    return copy


def test_keep_one_leaves_columns_of_any_name(spark):
    rows = [(i, f"one two three four five six seven {i // 2}", i, "k", "x", None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int, key string, __id string, __text string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["__key"]) for r in kept.collect()) == [(0, 0), (2, 2), (4, 4)]


@pytest.mark.parametrize("bucket", [4000, 12])
def test_near_documents_are_the_pairs_of_four_fifths(spark, bucket):
    """Whatever the edit's shape, on both sides of 0.8; the small bucket cuts every hot one."""
    random.seed(4)
    fresh = (f"w{i}" for i in range(10**7))
    rows = []
    for k in range(60):
        base = [next(fresh) for _ in range(random.randint(6, 250))]
        rows += [base, *[edited(shape, base, random.uniform(0.1, 0.26), fresh) for shape in ("appended", "cut", "scattered")]]
    base = [next(fresh) for _ in range(200)]
    rows += [edited("scattered", base, 0.1, fresh) for _ in range(40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    want = closure(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert 70 < len(set(want)) < 240
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    near = simhash.near_documents(docs, bucket=bucket).join(simhash.document_keys(docs).select("doc_id", "key", "key2"), ["key", "key2"])
    groups = {}
    for r in near.collect():
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted([i for i, w in enumerate(want) if w == g] for g in set(want))


def test_links_end_for_many_nodes_of_one_fingerprint(spark):
    df = spark.createDataFrame([(i, 5 if i < 60 else 7 if i < 80 else -1) for i in range(90)], "node long, fp long")
    got = {r.node: r.component for r in components.components(simhash.links(df, 4, bucket=8)).collect()}
    assert got == {i: 0 if i < 80 else 80 for i in range(90)}


def test_documents_under_four_fifths_stay(spark):
    """Five single edits in 200 words: a similarity of 171 / 221."""
    rows = []
    for k in range(40):
        base = [f"v{k}x{i}" for i in range(200)]
        rows += [base, [f"e{k}x{i}" if i % 40 == 20 else w for i, w in enumerate(base)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(80))


def test_near_documents_go_through_operator_4(spark, monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    other = words[:2000] + ["other"] + words[2001:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    a, b = simhash.fingerprint(" ".join(words)), simhash.fingerprint(" ".join(other))
    assert a != b and bin(a ^ b).count("1") <= 2
    monkeypatch.setattr(simhash, "_bands", lambda m: np.zeros(0, dtype=np.uint64))  # without the bands
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
