"""Toxicity: a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the hashed n-grams of the lower-cased text bytes (runs of white space count as one space), each present or absent in a
document. Naive Bayes counts over the labelled rows give every n-gram a log-count ratio; the ``features`` n-grams with the most
informative ratios become the inputs, scaled by their ratio, of a logistic regression with an L2 penalty. A score is its probability.

Defined results: a null text is an empty text; an empty text scores by the intercept; rows with a null label or id teach nothing;
labelled rows that repeat or disagree teach as often as they stand there; with no labelled row, or labels of one class only, every
score is the smoothed share of label 1. Scores depend on the text alone. Extra columns stay (``with_scores``) or go (``score``).

Only the fit works on a bounded sample: the ``max_train_rows`` labelled rows with the smallest hash of their id. It runs in one task.
Scoring covers every byte of every text in bounded Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field as attribute

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.llm.common import document_columns, field, held_out

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 22


@dataclass
class Model:
    """Slots (order, bucket) of the chosen n-grams, their weights (ratio times coefficient) and the intercept."""

    slots: np.ndarray = attribute(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = attribute(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def tables(self) -> list[np.ndarray]:
        """Per order: bucket -> 1 + index of the feature, or 0; built once per worker."""
        key = hash((self.slots.tobytes(), self.weights.tobytes()))
        if _TABLES.get("key") != key:
            made = []
            for k in range(len(ORDERS)):
                t = np.zeros(1 << BUCKET_BITS, dtype=np.int16 if len(self.slots) < 1 << 15 else np.int32)
                own = np.nonzero(self.slots >> BUCKET_BITS == k)[0]
                t[self.slots[own] & ((1 << BUCKET_BITS) - 1)] = own + 1
                made.append(t)
            _TABLES.update(key=key, tables=made)
        return _TABLES["tables"]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if len(self.slots):
            tables, starts, data = self.tables(), *_buffer(texts)
            for lo, hi in _pieces(starts):
                docs, feats = [], []
                for k, buckets, ends in _ngrams(data, starts, lo, hi):
                    slot = tables[k][buckets]
                    at = np.nonzero(slot)[0]
                    doc = np.searchsorted(starts[lo : hi + 1], at + starts[lo], side="right") - 1
                    inside = at + starts[lo] + ORDERS[k] <= ends[doc]
                    docs.append(doc[inside])
                    feats.append(slot[at][inside].astype(np.int64) - 1)
                pair = np.unique(np.concatenate(docs).astype(np.int64) * (len(self.slots) + 1) + np.concatenate(feats))
                d, f = np.divmod(pair, len(self.slots) + 1)
                out[lo:hi] += np.bincount(d, weights=self.weights[f], minlength=hi - lo)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -50, 50)))


_TABLES: dict = {}
_SPACES = bytes(range(9, 14))
_TO_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))


def _buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the texts, and their normalised bytes one after the other (padded, so that every n-gram can be read)."""
    parts = [b" " + b" ".join((t or "").encode().lower().translate(_TO_SPACE).split()) + b" " for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return starts, np.frombuffer(b"".join(parts) + b"\0" * 8, dtype=np.uint8)


def _pieces(starts: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``most`` bytes, or one longer text."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _ngrams(data, starts, lo, hi):
    """For each order the bucket of the n-gram at every byte of texts lo..hi, and where each text ends."""
    b = data[starts[lo] : starts[hi] + 8].astype(np.uint32)
    n = int(starts[hi] - starts[lo])
    h = b[:n].copy()
    for size in range(2, ORDERS[-1] + 1):
        h *= np.uint32(0x01000193)
        h ^= b[size - 1 : n + size - 1]
        h ^= h >> np.uint32(15)
        if size in ORDERS:
            yield ORDERS.index(size), (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), starts[lo + 1 : hi + 1]


def _features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Distinct slots of each text, one after the other."""
    for t in texts:
        starts, data = _buffer([t])
        own = [np.unique(b[: max(0, int(e[0]) - ORDERS[k] + 1)]) | np.uint32(k << BUCKET_BITS) for k, b, e in _ngrams(data, starts, 0, 1)]
        yield np.concatenate(own)


def fit(texts: list[str | None], labels: np.ndarray, features: int = 4096, penalty: float = 0.05, smoothing: float = 1.0, steps: int = 60) -> Model:
    """Naive Bayes ratios from presence counts, the most informative n-grams, then Newton steps on the penalised log-likelihood."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(intercept=prior)
    size = len(ORDERS) << BUCKET_BITS
    seen = [np.zeros(size, dtype=np.int32) for _ in range(2)]
    for r, y in zip(_features(texts), labels):
        seen[int(y)][r] += 1
    some = np.nonzero(seen[0] + seen[1] >= 3)[0]
    p, q = (seen[1][some] + smoothing) / (n1 + 2 * smoothing), (seen[0][some] + smoothing) / (n0 + 2 * smoothing)
    ratio = np.log(p / q)
    # how far the share of label 1 among the texts with the n-gram lies from the prior, in standard errors
    with_it = (seen[0] + seen[1])[some]
    share = n1 / (n1 + n0)
    weight = np.abs(seen[1][some] - with_it * share) / np.sqrt(with_it * share * (1 - share) + 1)
    best = np.lexsort((some, -weight))[:features]
    chosen = np.sort(some[best])
    ratio = ratio[np.searchsorted(some, chosen)]
    place = np.zeros(size, dtype=np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)
    cols = []
    for r in _features(texts):  # again, so that only the chosen ones are held
        c = place[r]
        cols.append(c[c > 0] - 1)
    line = np.repeat(np.arange(len(texts)), [len(c) for c in cols])
    col = np.concatenate(cols) if len(line) else np.zeros(0, np.int64)
    value = ratio[col]

    def times(w):
        return np.bincount(line, weights=value * w[col], minlength=len(texts))

    def back(v):
        return np.bincount(col, weights=value * v[line], minlength=len(chosen))

    w, b, y = np.zeros(len(chosen)), prior, labels.astype(float)
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-np.clip(times(w) + b, -30, 30)))
        g, gb, s = back(mu - y) + penalty * len(chosen) ** 0.5 * w, float((mu - y).sum()), mu * (1 - mu) + 1e-6
        # one Newton direction by conjugate gradients on (weights, intercept)
        lam = penalty * len(chosen) ** 0.5
        dw, db = np.zeros_like(w), 0.0
        rw, rb = -g, -gb
        pw, pb = rw.copy(), rb
        rr = rw @ rw + rb * rb
        for _ in range(40):
            z = s * (times(pw) + pb)
            hw, hb = back(z) + lam * pw, float(z.sum())
            a = rr / max(pw @ hw + pb * hb, 1e-12)
            dw, db, rw, rb = dw + a * pw, db + a * pb, rw - a * hw, rb - a * hb
            new = rw @ rw + rb * rb
            if new < 1e-8 * (g @ g + gb * gb):
                break
            pw, pb, rr = rw + new / rr * pw, rb + new / rr * pb, new
        w, b = w + dw, b + db
        if max(np.abs(dw).max(initial=0), abs(db)) < 1e-4:
            break
    return Model(chosen.astype(np.int64), ratio * w, b)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, max_train_rows: int = 12_000, **options) -> Model:
    """Fit on the labelled rows outside the held-out fold; at most ``max_train_rows`` of them, those with the smallest id hash."""
    marked = labels.select(field(labels, "doc_id").cast("long").alias("doc_id"), field(labels, "toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", modulus, remainder))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train_rows)
    rows = document_columns(docs).join(chosen, "doc_id")

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, ids, marks = [], [], []
        for p in parts:
            texts += p["text"].tolist()
            ids += p["doc_id"].tolist()
            marks += p["toxic"].tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i], texts[i]))
        m = fit([texts[i] for i in order], np.array([int(marks[i] > 0) for i in order]), **options)
        yield pd.DataFrame({"slots": [m.slots.tolist()], "weights": [m.weights.tolist()], "intercept": [m.intercept]})

    got = rows.repartition(1).mapInPandas(learn, "slots array<long>, weights array<double>, intercept double").collect()
    if not got:
        return Model(intercept=float(np.log(0.5 / 0.5)))
    return Model(np.array(got[0]["slots"], dtype=np.int64), np.array(got[0]["weights"], dtype=float), got[0]["intercept"])


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text.tolist()), dtype="float64")

    return score


def score_column(model: Model, text: Column) -> Column:
    return scorer(model)(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = document_columns(docs).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows scored below the threshold, with all their columns."""
    return docs.where(score_column(model, field(docs, "text")) < threshold)
