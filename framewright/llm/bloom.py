"""Bloom filters built and probed by DataFrame operations only.

A filter of 2**bits slots is a table of 4 KB bitmaps, one for each 32,768 slots that hold anything.
Its size has a bound that does not depend on the data (``MAX_BITS``: 2**29 slots, 64 MB), so it can
be broadcast. ``met_again`` takes as many filters as its keys need, one for each range of a hash, and
reads its slim rows once for each. ``without`` has one: past its capacity (some 33 million ids that go)
it lets more rows through to the shuffle, never fewer.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.joins import column_of, packed, shuffled
from framewright.llm.lineage import cut

#: Slots a key is given, and the largest filter, as a power of two of its slots.
SLOTS_PER_KEY = 16
MAX_BITS = 29
_PAGE = 32768


def bits_for(n_keys: int) -> int:
    return min(MAX_BITS, max(16, math.ceil(math.log2(max(1, n_keys) * SLOTS_PER_KEY))))


def slots(key: Column, bits: int) -> list[Column]:
    """Two slots of a 64-bit key."""
    mask = (1 << bits) - 1
    return [key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 64 - bits).bitwiseAND(F.lit(mask))]


def _pages(slot_rows: DataFrame) -> DataFrame:
    """Bitmaps of a column ``slot``."""
    return (
        slot_rows.groupBy(F.shiftright("slot", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(_PAGE - 1))).alias("bitmap"))
    )


def members(keys: DataFrame, key_col: str, bits: int) -> DataFrame:
    """The filter of all keys."""
    return _pages(keys.select(F.explode(F.array(*slots(F.col(key_col), bits))).alias("slot")))


def repeated(keys: DataFrame, key_col: str, bits: int) -> DataFrame:
    """The filter of slots that at least two rows fall into.

    Rows are summed by slot before the shuffle, so a key that a third of all rows carry costs one
    row for each task.
    """
    # The two slots of one key may coincide; the pair then counts once for each row.
    a, b = slots(F.col(key_col), bits)
    each = F.explode(F.array_distinct(F.array(a, b))).alias("slot")
    twice = keys.select(each).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return _pages(twice.select("slot"))


def _holds(bitmap: Column, slot: Column) -> Column:
    byte = F.shiftright(slot.bitwiseAND(F.lit(_PAGE - 1)), 3).cast("int") + 1
    value = F.conv(F.hex(F.substring(bitmap, byte, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int"))
    return F.coalesce(value.bitwiseAND(bit) != 0, F.lit(False))


def probe(df: DataFrame, key_col: str, pages: DataFrame, bits: int, out: str) -> DataFrame:
    """Adds boolean ``out``: whether every slot of the key is set. Null keys: false.

    The pages are broadcast; ``MAX_BITS`` bounds them. ``df`` is a helper frame, without columns named
    like those made here (``joins.packed`` holds a caller's).
    """
    a, b = slots(F.col(key_col), bits)
    first = F.broadcast(pages.select(F.col("page").alias("_page_a"), F.col("bitmap").alias("_bitmap_a")))
    second = F.broadcast(pages.select(F.col("page").alias("_page_b"), F.col("bitmap").alias("_bitmap_b")))
    names = df.columns
    return (
        df.join(first, F.shiftright(a, 15) == F.col("_page_a"), "left")
        .withColumn("_hit_a", _holds(F.col("_bitmap_a"), a))
        .select(*names, "_hit_a")
        .join(second, F.shiftright(b, 15) == F.col("_page_b"), "left")
        .select(*names, (F.col("_hit_a") & _holds(F.col("_bitmap_b"), b)).alias(out))
    )


def collected(pages: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes, for tasks in Python; ``MAX_BITS`` bounds them."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    for page, bitmap in pages.collect():
        at = page * _PAGE // 8
        out[at : at + _PAGE // 8] = np.frombuffer(bitmap, np.uint8)[: len(out) - at]
    return out


def holds(filter_bytes: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether every slot of each unsigned key is set, as ``probe`` tells it."""
    a, b = keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)
    first, second = (filter_bytes[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8) for s in (a, b))
    return (first & second & 1).astype(bool)


def met_again(rows: DataFrame, key_col: str, total: int, out: str) -> DataFrame:
    """Adds boolean ``out``: false only where no other of the ``total`` rows has the same key.

    However many rows there are, a filter has ``SLOTS_PER_KEY`` slots for each of its own; ``rows`` is
    read twice for each filter, so it should be slim and written.
    """
    n = max(1, math.ceil(total * SLOTS_PER_KEY / (1 << MAX_BITS)))
    bits = bits_for(math.ceil(total / n))
    parts = []
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.col(key_col)), F.lit(n)) == k)
        parts.append(probe(own, key_col, repeated(own, key_col, bits), bits, out))
    return reduce(DataFrame.unionByName, parts)


def without(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id isn't in ``gone`` (one column), all columns as they were.

    A filter of the ids in ``gone`` lets other rows pass straight through; only rows that it may hold
    meet ``gone`` in a shuffle. Null ids stay.
    """
    gone = cut(gone.toDF("_gone").filter("_gone IS NOT NULL").distinct())
    bits = bits_for(gone.count())
    pages = members(gone.select(F.xxhash64("_gone").alias("_key")), "_key", bits)
    rows = df.select(packed(df).alias("_row"), column_of(id_col).alias("_id"))
    whole = probe(rows.withColumn("_key", F.xxhash64("_id")), "_key", pages, bits, "_maybe")
    maybe = whole.filter("_maybe").join(shuffled(gone), F.col("_id") == F.col("_gone"), "left_anti")
    return whole.filter("not _maybe").select("_row.*").unionByName(maybe.select("_row.*"))
