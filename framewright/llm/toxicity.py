"""Toxicity classifier: a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, hashed to a fixed number of buckets. Beside a
weight, each term has a short vector; the product of two terms' vectors is the weight of their meeting
in one text, so that an insult beside the mention of a group can weigh more than both alone. Weights
and vectors minimise the logistic loss by adaptive gradient steps, in two runs. The first gives them to
every term in at least ``LEAST_TEXTS`` texts of the sample, under penalties that take whole vectors down
to nought; so terms that tell nothing alone but something together stand out by their vectors. The
second has the ``MEETING`` longest of these and the terms whose own share tells the classes apart.

The fit uses at most ``PER_CLASS`` labelled documents of each class; scoring covers every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from framewright.llm.labelled import Sample, bounded_sample, buckets, calibrate, distinct, prefix_hashes, score_texts, sigmoid, word_docs
from framewright.llm.text import Words, combine

BITS = 20
PER_CLASS = 3000
FACTORS = 4
EPOCHS = 20
BATCH = 128
RATE = 0.3
#: Size of the first, random vectors, and the rate of their steps.
START, VECTOR_RATE = 0.02, 0.1
#: The run over all frequent terms: epochs, its penalty on weights and whole vectors, and how many of
#: its terms go on by their vectors.
WIDE_EPOCHS, WIDE_LASSO, MEETING = 10, 1e-2, 64
#: Penalties on the size of weights and of vectors, and how many sample texts a term must be in.
LASSO = 1e-3
RIDGE = 1e-3
LEAST_TEXTS = 4
LEAST_Z = 3.5
PREFIXES = (4, 5, 6)


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs of a block's terms, repeats included; a text of no words has none."""
    docs = word_docs(w)
    found, where = [combine(w.hashes, np.uint64(1))], [docs]
    for k in PREFIXES:
        h = prefix_hashes(w, k)
        live = h != 0
        found.append(h[live])
        where.append(docs[live])
    return np.concatenate(where), buckets(np.concatenate(found), BITS)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*terms(w), BITS)


@dataclass
class FactorizationMachine:
    number: np.ndarray  # int32 by bucket, -1 or the term's place below
    bias: float
    weights: np.ndarray  # float32 by term
    vectors: np.ndarray  # float32, FACTORS by term
    slope: float
    offset: float

    def margins(self, docs: np.ndarray, buckets: np.ndarray, n_docs: int) -> np.ndarray:
        term = self.number[buckets]
        live = term >= 0
        docs, term = docs[live], term[live]
        total = self.bias + np.bincount(docs, weights=self.weights[term], minlength=n_docs)
        for v in self.vectors:
            x = v[term]
            total += 0.5 * (np.bincount(docs, weights=x, minlength=n_docs) ** 2 - np.bincount(docs, weights=x * x, minlength=n_docs))
        return total

    def score(self, w: Words) -> np.ndarray:
        d, f = terms(w)
        live = self.number[f] >= 0
        return sigmoid(self.slope * self.margins(*distinct(d[live], f[live], BITS), w.n_docs) + self.offset)


def telling_terms(s: Sample, picked: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Buckets whose share of texts differs between the classes by ``LEAST_Z`` standard errors."""
    texts = [np.bincount(s.features[(picked & (s.labels == y))[row_of]], minlength=1 << BITS) for y in (0, 1)]
    n = [max(1, (picked & (s.labels == y)).sum()) for y in (0, 1)]
    pooled = (texts[0] + texts[1]) / (n[0] + n[1])
    error = np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1])) + 1e-12
    z = np.abs(texts[1] / n[1] - texts[0] / n[0]) / error
    return np.flatnonzero((z >= LEAST_Z) & (texts[0] + texts[1] >= LEAST_TEXTS))


def descend(s: Sample, rows: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """The machine of ``rows``: first all frequent terms under penalties, which show what counts in
    meetings; then those terms and the telling ones without."""
    row_of = np.repeat(np.arange(len(s.labels)), np.diff(s.bounds))
    picked = np.zeros(len(s.labels), bool)
    picked[rows] = True
    frequent = np.flatnonzero(np.bincount(s.features[picked[row_of]], minlength=1 << BITS) >= LEAST_TEXTS)
    wide = Descent(s, rows, frequent, row_of, seed)
    wide.run(WIDE_EPOCHS, penalised=True)
    norm = (wide.v**2).sum(axis=0)
    meeting = np.sort(np.argsort(-norm, kind="stable")[:MEETING])
    meeting = meeting[norm[meeting] > 0]
    chosen = np.union1d(telling_terms(s, picked, row_of), frequent[meeting])
    own = Descent(s, rows, chosen, row_of, seed)
    at = np.searchsorted(chosen, frequent[meeting])
    own.w[at], own.v[:, at] = wide.w[meeting], wide.v[:, meeting]
    own.run(EPOCHS, penalised=False)
    return FactorizationMachine(own.number, own.bias, own.w.astype(np.float32), own.v.astype(np.float32), 1.0, 0.0)


class Descent:
    """Weights ``w`` and vectors ``v`` of chosen terms, by adaptive gradient steps on the logistic loss.

    ``penalised`` steps shrink weights and whole vectors down to nought where meetings tell nothing.
    """

    def __init__(self, s: Sample, rows: np.ndarray, chosen: np.ndarray, row_of: np.ndarray, seed: int):
        self.rng, self.rows = np.random.default_rng(seed), rows
        self.number = np.full(1 << BITS, -1, np.int32)
        self.number[chosen] = np.arange(len(chosen))
        live = self.number[s.features] >= 0
        self.term = self.number[s.features[live]].astype(np.int64)
        self.bounds = np.searchsorted(row_of[live], np.arange(len(s.labels) + 1))
        self.y = (s.labels == 1).astype(float)
        share = min(0.95, max(0.05, self.y[rows].mean()))
        self.bias = float(np.log(share / (1 - share)))
        self.m = len(chosen)
        self.w, self.v = np.zeros(self.m), self.rng.normal(0, START, (FACTORS, self.m))

    def run(self, epochs: int, penalised: bool) -> None:
        m, w, v = self.m, self.w, self.v
        gb, gw, gv = 1.0, np.full(m, 1.0), np.full((FACTORS, m), 1.0)
        for _ in range(epochs):
            order = self.rng.permutation(self.rows)
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                n = len(some)
                lens = self.bounds[some + 1] - self.bounds[some]
                d = np.repeat(np.arange(n), lens)
                t = self.term[np.repeat(self.bounds[some] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())]
                own = [f[t] for f in v]
                sums = [np.bincount(d, weights=x, minlength=n) for x in own]
                pairs = sum(a * a - np.bincount(d, weights=x * x, minlength=n) for a, x in zip(sums, own, strict=True))
                g = sigmoid(self.bias + np.bincount(d, weights=w[t], minlength=n) + 0.5 * pairs) - self.y[some]
                gb += g.sum() ** 2
                self.bias -= RATE * g.sum() / np.sqrt(gb)
                each = g[d]
                dw = np.bincount(t, weights=each, minlength=m)
                gw += dw * dw
                rate = RATE / np.sqrt(gw)
                w -= rate * dw * (1 if penalised else 3)
                w[:] = np.sign(w) * np.maximum(0, np.abs(w) - rate * (WIDE_LASSO if penalised else LASSO) * n)
                for k in range(FACTORS):
                    dv = np.bincount(t, weights=each * (sums[k][d] - own[k]), minlength=m) + (0 if penalised else RIDGE * n * v[k])
                    gv[k] += dv * dv
                    v[k] -= VECTOR_RATE * dv / np.sqrt(gv[k])
                if penalised:
                    norm = np.sqrt((v * v).sum(axis=0)) + 1e-12
                    v *= np.maximum(0, 1 - VECTOR_RATE / np.sqrt(gv.mean(axis=0)) * WIDE_LASSO * n / norm)


def fit(s: Sample) -> FactorizationMachine:
    """The model of a sample; with one class only, or no rows, the score is that class's share."""
    if len(np.unique(s.labels)) < 2:
        chance = min(1 - 1e-6, max(1e-6, s.share))
        none = np.zeros(0, np.float32)
        return FactorizationMachine(np.full(1 << BITS, -1, np.int32), float(np.log(chance / (1 - chance))), none, np.zeros((FACTORS, 0), np.float32), 1.0, 0.0)
    rows = np.arange(len(s.labels))
    row_of = np.repeat(rows, np.diff(s.bounds))
    margins = np.full(len(rows), np.nan)
    halves = [rows[rows % 2 == k] for k in (0, 1)]
    if all(len(np.unique(s.labels[h])) == 2 for h in halves):
        for learn, hold in (halves, halves[::-1]):
            margins[hold] = descend(s, learn).margins(row_of, s.features, len(rows))[hold]
    model = descend(s, rows)
    if np.isnan(margins).any():
        margins = model.margins(row_of, s.features, len(rows))
    slope, offset = calibrate(margins, s.labels, s.share)
    model.slope, model.offset = max(slope, 1e-3), offset
    return model


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fits the labels of rows that ``trains`` (over doc_id) admits."""
    return fit(bounded_sample(docs, labels, label, trains, features, per_class))


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Adds ``out``, the chance of label 1 by the whole text; null and empty texts get that of no terms.

    One row for each input row, whatever its other columns; one named like ``out`` is replaced. A text of
    any length is scored whole, by one task; an empty frame gives an empty one.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS buckets at most, whatever the corpus
    return score_texts(df, text_col, lambda w: held.value.score(w), keep, out)
