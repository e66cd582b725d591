"""How the filters of a text corpus interact: what each removes, repeats and costs in every order.

``measure`` scans whole Arrow text buffers with numpy: a table gives each byte's class, prefix sums of classes over
the buffer give every text's words, capitals, symbols and code points at once. Distinct words come from sorted
64-bit word hashes of each text; equal neighbours are verified byte by byte, and a text in which two different
words share a hash is counted by its words themselves. ``flag`` turns figures into a mask, a bit for each filter
that a text fails, and ``mark_repeats`` adds the bit of texts met before. ``interactions`` reduces masks: all orders
follow from the count of each mask, so nothing but a few rows for each part is left after one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.arrow import append_columns, text_view
from framewright.llm.joins import column_of, hot_join
from framewright.llm.lineage import cut
from framewright.llm.text import mix

#: The characters that count as symbols.
SYMBOLS = "#$%&*|"

BLANK, CAPITAL, SYMBOL, LEAD = 1, 2, 4, 8
#: Classes of bytes, one bit each; LEAD marks the first byte of a character.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(9, 14), 32]] |= BLANK
CLASSES[65:91] |= CAPITAL
CLASSES[[ord(c) for c in SYMBOLS]] |= SYMBOL
CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= LEAD

U64 = np.uint64
_VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=U64, endpoint=False)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def bounds_of_words(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a text's end ends its last one."""
    n = len(classes)
    solid = (classes & BLANK) == 0
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """Hashes of the words between bounds: a polynomial of a word's bytes from prefix sums, window by window of
    whole words (a longer word makes its own), so that a very long text needs no more than a short one."""
    out = np.empty(len(starts), U64)
    up = down = np.zeros(0, U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + window, "right")))
        part = raw[a : int(ends[j - 1])]
        if len(up) < len(part):
            size = max(len(part), min(window, len(raw)))
            up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(_VALUES[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each text, whose words are ``bounds[d]:bounds[d + 1]``."""
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
    a, b = order[same], order[same + 1]
    counts = np.diff(bounds) - np.bincount(d[same + 1], minlength=n_docs)
    for x, y in _blocks(ends[a] - starts[a]):  # verify words that share a hash
        one, two = a[x:y], b[x:y]
        size = ends[one] - starts[one]
        wrong = size != ends[two] - starts[two]
        ok = np.flatnonzero(~wrong)
        size = size[ok]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = raw[np.repeat(starts[one[ok]], size) + step] != raw[np.repeat(starts[two[ok]], size) + step]
        wrong[np.repeat(ok, size)[differs]] = True
        for t in np.unique(doc[one[wrong]]).tolist():
            counts[t] = len({raw[s:e].tobytes() for s, e in zip(starts[bounds[t] : bounds[t + 1]], ends[bounds[t] : bounds[t + 1]], strict=True)})
    return counts


def _blocks(sizes: np.ndarray, limit: int = 1 << 20):
    """Index ranges whose sizes sum up to about ``limit``."""
    total = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def figures(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text of a block."""
    classes = CLASSES[raw]
    starts, ends = bounds_of_words(classes, offsets)
    bounds = np.searchsorted(starts, offsets)
    distinct = distinct_words(raw, starts, ends, bounds, word_hashes(raw, starts, ends))

    def per_text(bit: int) -> np.ndarray:
        prefix = np.concatenate(([0], np.cumsum((classes & bit) != 0)))
        return np.diff(prefix[offsets])

    return [np.diff(bounds), distinct, per_text(CAPITAL), per_text(LEAD), per_text(SYMBOL)]


FIGURES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")])


def measure(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_distinct`` (case-sensitive), ``n_capitals`` (A-Z), ``n_points`` (code points) and
    ``n_symbols``. A null text counts as empty: all are 0. A column of such a name is replaced."""

    def make():
        def run(col: pa.Array) -> list:
            raw, off = text_view(col)
            return figures(raw[off[0] : off[-1]], off - off[0])

        return run

    return append_columns(df, text_col, FIGURES, make, keep)


def flag(measured: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Adds ``mask``: bit i is set where the i-th filter's failure condition holds (null: it doesn't)."""
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return measured.withColumn("mask", mask.cast("int"))


def mark_repeats(flagged: DataFrame, bit: int, id_col: str = "doc_id", key_col: str = "text_key") -> DataFrame:
    """Sets a bit of ``mask`` in rows whose key a row of a smaller id has, wherever in the table it is.

    Rows of one id don't repeat each other, and a null id is smaller than none. Only keys of two rows and more are
    joined back, hot ones by broadcast. The rows are read three times: give a frame that is cut.
    """
    found = flagged.groupBy(key_col).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    joined = hot_join(flagged, found, [key_col], "_n", flagged.count())
    again = F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))
    return joined.withColumn("mask", F.when(again, F.col("mask").bitwiseOR(1 << bit)).otherwise(F.col("mask"))).drop("_first")


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """For each part, order of the filters and step: counts of what that step does.

    ``masks``: (part, mask, good, toxic, n), n rows each. ``letters`` names the filters, bit by bit; all orders of
    them are looked at, so there may be seven at most. Out: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley; a row for every part, order and step, zeros included.
    No masks: no rows.
    """
    if len(letters) > 7 or len(set(letters)) != len(letters):
        raise ValueError("up to seven filters, each with a letter of its own")
    counted = masks.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))  # at most 2**letters * 4 a part
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bits = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    rows = counted.withColumn("filter_order", F.explode(orders))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("_at", "_letter")).withColumn("_bit", F.element_at(bits, F.col("_letter")))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("_at")), F.lit(0), lambda total, c: total + F.element_at(bits, c))
    rows = rows.withColumn("_before", before)
    fails, earlier = F.col("mask").bitwiseAND(F.col("_bit")) != 0, F.col("mask").bitwiseAND(F.col("_before")) != 0
    count = lambda holds: F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", (F.col("_at") + 1).cast("int").alias("step"), "_letter").agg(
        count(~fails & ~earlier).alias("kept"), count(fails & ~earlier).alias("removed"), count(fails & earlier).alias("redundant"),
        count(F.col("mask") == F.col("_bit")).alias("unique_fails"), count(fails & ~earlier & F.col("good")).alias("good_lost"),
        count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")


def text_filters() -> dict[str, Column]:
    """Failure conditions of the four filters that look at one text, of ``measure``'s figures."""
    return {
        "A": F.col("n_words") < 200,
        "B": F.col("n_distinct") * 100 < F.col("n_words") * 50,
        "C": F.col("n_capitals") * 100 > F.col("n_points") * 3,
        "D": F.col("n_symbols") > 0,
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of ``text_filters`` and, as E, of texts that a smaller id has.

    Null parts are the part ''. Labels: (id, quality, toxic); of several rows of an id any 1 counts, an id without a
    label is neither good nor toxic, and a null id has none. Repeated ids count as a row each. An empty corpus
    gives no rows. Other columns aren't read. Texts are compared by SHA-256; a null text is an empty one.
    """
    text = F.coalesce(column_of(text_col), F.lit(""))
    slim = docs.select(column_of(id_col).alias("doc_id"), F.coalesce(column_of(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))
    filters = text_filters()
    flagged = cut(flag(measure(slim, keep=["doc_id", "part", "text_key"]), filters).select("doc_id", "part", "text_key", "mask"))
    marked = mark_repeats(flagged, len(filters))
    grouped = marked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))  # a hot id is a few rows now
    known = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = grouped.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return interactions(joined, "".join(filters) + "E")
