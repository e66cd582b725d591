"""Labelled training samples of bounded size, and sparse features by hashing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.arrow import append_columns
from framewright.llm.text import BLANK, LOWER, Words, combine, mix, words

U64 = np.uint64


def split_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


@dataclass
class Sample:
    """CSR rows of distinct feature numbers, their labels, and each class's share among all labels."""

    bounds: np.ndarray
    features: np.ndarray
    labels: np.ndarray
    share: float  # of label 1 among all training labels


#: A feature function: the words of a block to (document, feature) pairs, distinct and sorted.
Features = Callable[[Words], tuple[np.ndarray, np.ndarray]]


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def distinct(docs: np.ndarray, numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, number) pairs, sorted; numbers are below 2**bits."""
    keys = np.unique((docs.astype(np.int64) << bits) | numbers)
    return keys >> bits, keys & ((1 << bits) - 1)


def prefix_hashes(w: Words, length: int) -> np.ndarray:
    """Hash of each word's first ``length`` (at most 8) bytes, lower-cased in A-Z; 0 for shorter words."""
    packed = np.zeros(len(w.starts), U64)
    whole = w.ends - w.starts >= length
    at = w.starts[whole]
    value = np.zeros(len(at), U64)
    for k in range(length):
        value = (value << U64(8)) | LOWER[w.raw[at + k]].astype(U64)
    packed[whole] = combine(value, np.full(len(at), length, U64))
    return packed


#: Shape classes of a word, as bits: holds lower case, upper case, digits, other ASCII, non-ASCII.
_KIND = np.full(256, 16, np.uint8)
_KIND[33:127] = 8
_KIND[48:58] = 4
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[BLANK] = 0


def shapes(w: Words) -> np.ndarray:
    """A small number for each word: its character classes, whether it begins in upper case, the class
    of its last byte, whether it is one byte long, and whether it repeats the word before it."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, U64)
    kinds = np.bitwise_or.reduceat(_KIND[w.raw], w.starts).astype(U64)
    first, last = _KIND[w.raw[w.starts]].astype(U64), _KIND[w.raw[w.ends - 1]].astype(U64)
    same = np.zeros(n, U64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    at = w.bounds[:-1]
    same[at[at < n]] = 0
    short = (w.ends - w.starts == 1).astype(U64)
    return kinds | first << U64(5) | last << U64(10) | short << U64(15) | same << U64(16)


def word_docs(w: Words) -> np.ndarray:
    return np.repeat(np.arange(w.n_docs), np.diff(w.bounds))


def grams(values: np.ndarray, docs: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, hashes) of the ``size``-grams of a word-level sequence that stay in one text."""
    if len(values) < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    n = len(values) - size + 1
    acc = np.full(n, mix(np.array([salt * 16 + size], U64))[0], U64)
    for k in range(size):
        acc = combine(acc, values[k : k + n])
    inside = docs[:n] == docs[size - 1 :]
    return docs[:n][inside], acc[inside]


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, features: Features, per_class: int) -> Sample:
    """Features of at most ``per_class`` labelled training documents of each class.

    The ids with the smallest hash are taken, and of rows that share an id the one with the smallest
    digest of its text, so the sample doesn't depend on the order or the layout of the tables and has
    a row for each id at most, however often one repeats. Ids and labels that are null are left out,
    and ids that are labelled both ways.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & trains)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 1").orderBy(*order).limit(per_class).unionByName(known.filter("label = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids, so this side may be broadcast whatever the corpus.
    met = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = met.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    schema = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType(), False))])

    def make():
        def run(col: pa.Array) -> list:
            w = words(col)
            d, f = features(w)
            bounds = np.searchsorted(d, np.arange(w.n_docs + 1)).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32)))]

        return run

    rows = append_columns(texts, "text", schema, make, ["doc_id", "label"]).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = rows.column("features").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    total = sum(counts.values())
    return Sample(
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        flat,
        rows.column("label").to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64),
        counts.get(1, 0) / total if total else 0.5,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def calibrate(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, offset) of the logistic curve from margins to the chance of label 1, by Newton's method.

    Classes are weighed to ``share``, their share among all labels, whatever the sample's; targets are
    smoothed so that separable margins give a finite curve.
    """
    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, share / n1, (1 - share) / n0) * len(labels)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        ga, gb = (g * margins).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margins**2).sum() + 1e-3, (h * margins).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def score_texts(df: DataFrame, text_col: str, score: Callable[[Words], np.ndarray], keep: list[str] | None, out: str = "score") -> DataFrame:
    """Adds a double column of one score for each text."""

    def make():
        return lambda col: [pa.array(score(words(col)).astype(np.float64))]

    return append_columns(df, text_col, T.StructType([T.StructField(out, T.DoubleType())]), make, keep)
