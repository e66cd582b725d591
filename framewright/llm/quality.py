"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, pairs of words, and n-grams of word shapes (character
classes and whether a word repeats the one before), hashed to a fixed number of buckets. Each
indicator is scaled by its naive Bayes log-count ratio between the classes, and a linear model with
hinge loss is fitted to the scaled indicators by dual coordinate descent. A logistic curve, fitted to
margins of held-out halves, turns margins into chances.

The fit uses at most ``PER_CLASS`` labelled documents of each class; scoring covers every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from framewright.llm.labelled import Sample, bounded_sample, buckets, calibrate, distinct, grams, score_texts, shapes, sigmoid, word_docs
from framewright.llm.text import Words

BITS = 20
PER_CLASS = 3000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: Longest n-gram of word shapes.
SHAPE_GRAM = 5


def n_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs of a block's n-grams, repeats included; a text of no words has none."""
    docs = word_docs(w)
    found = [grams(w.hashes, docs, 1, 1), grams(w.hashes, docs, 2, 2)]
    shape = shapes(w)
    found += [grams(shape, docs, k, 3) for k in range(1, SHAPE_GRAM + 1)]
    return np.concatenate([d for d, _ in found]), buckets(np.concatenate([h for _, h in found]), BITS)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*n_grams(w), BITS)


@dataclass
class NaiveBayesSvm:
    ratios: np.ndarray  # float32 by bucket, the log-count ratio; 0 for a bucket not in the sample
    weights: np.ndarray  # float32 by bucket, ratio and weight of the hyperplane multiplied
    bias: float
    slope: float
    offset: float

    def margins(self, docs: np.ndarray, buckets: np.ndarray, n_docs: int) -> np.ndarray:
        """Margins of texts by their distinct buckets: scaled indicators are brought to unit length, as in the fit."""
        length = np.sqrt(np.bincount(docs, weights=self.ratios[buckets].astype(float) ** 2, minlength=n_docs))
        return np.bincount(docs, weights=self.weights[buckets], minlength=n_docs) / (length + 1e-12) + self.bias

    def score(self, w: Words) -> np.ndarray:
        d, f = n_grams(w)
        live = self.ratios[f] != 0
        return sigmoid(self.slope * self.margins(*distinct(d[live], f[live], BITS), w.n_docs) + self.offset)


def log_count_ratio(s: Sample, rows: np.ndarray) -> np.ndarray:
    """Of each bucket, log of its smoothed share among label 1's indicators to that among label 0's; a
    bucket that no row holds tells nothing and has 0."""
    picked = np.zeros(len(s.labels), bool)
    picked[rows] = True
    row = np.repeat(np.arange(len(s.labels)), np.diff(s.bounds))
    met = [np.bincount(s.features[(picked & (s.labels == y))[row]], minlength=1 << BITS) for y in (1, 0)]
    one, zero = (SMOOTHING + c for c in met)
    return np.where(met[0] + met[1] > 0, np.log(one / one.sum()) - np.log(zero / zero.sum()), 0.0)


def dual_coordinate_descent(s: Sample, rows: np.ndarray, scale: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + COST * sum of hinge losses over ``rows``.

    One dual variable at a time, between 0 and its class's cost, in a new random order each epoch.
    Rows are brought to unit length; the bias is the weight of a constant feature.
    """
    rng = np.random.default_rng(seed)
    y = np.where(s.labels == 1, 1.0, -1.0)
    w, bias = np.zeros(1 << BITS), 0.0
    items = []
    for i in rows:
        f = s.features[s.bounds[i] : s.bounds[i + 1]]
        v = scale[f]
        live = v != 0
        f, v = f[live], v[live]
        items.append((f, v / (np.sqrt((v * v).sum()) + 1e-12)))
    alpha = np.zeros(len(rows))
    for _ in range(EPOCHS):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            f, v = items[k]
            t = y[rows[k]]
            slack = t * (w[f] @ v + bias) - 1.0
            new = min(COST, max(0.0, alpha[k] - slack / 2.0))  # |x|^2 and the constant: 2
            if new != alpha[k]:
                step = (new - alpha[k]) * t
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(s: Sample) -> NaiveBayesSvm:
    """The model of a sample; with one class only, or no rows, the score is that class's share."""
    if len(np.unique(s.labels)) < 2:
        chance = min(1 - 1e-6, max(1e-6, s.share))
        none = np.zeros(1 << BITS, np.float32)
        return NaiveBayesSvm(none, none, 0.0, 1.0, float(np.log(chance / (1 - chance))))
    rows = np.arange(len(s.labels))
    row_of = np.repeat(rows, np.diff(s.bounds))

    def learn(part: np.ndarray) -> NaiveBayesSvm:
        ratio = log_count_ratio(s, part)
        w, b = dual_coordinate_descent(s, part, ratio)
        return NaiveBayesSvm(ratio.astype(np.float32), (w * ratio).astype(np.float32), float(b), 1.0, 0.0)

    model, margins = learn(rows), np.full(len(rows), np.nan)
    halves = [rows[rows % 2 == k] for k in (0, 1)]
    if all(len(np.unique(s.labels[h])) == 2 for h in halves):
        for part, hold in (halves, halves[::-1]):
            margins[hold] = learn(part).margins(row_of, s.features, len(rows))[hold]
    else:
        margins = model.margins(row_of, s.features, len(rows))
    slope, offset = calibrate(margins, s.labels, s.share)
    model.slope, model.offset = max(slope, 1e-3), offset
    return model


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", per_class: int = PER_CLASS) -> NaiveBayesSvm:
    """Fits the labels of rows that ``trains`` (over doc_id) admits."""
    return fit(bounded_sample(docs, labels, label, trains, features, per_class))


def score(df: DataFrame, model: NaiveBayesSvm, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score``, the chance of label 1 by the whole text; null and empty texts get that of no n-grams.

    One row for each input row, whatever its other columns; one named ``score`` is replaced. A text of
    any length is scored whole, by one task; an empty frame gives an empty one.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus
    return score_texts(df, text_col, lambda w: held.value.score(w), keep)
