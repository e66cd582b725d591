"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

Test items are short and documents long, so similarity of whole sets says nothing; what counts is the
share of an item's shingles that a document holds, its containment. Items are partitioned by the size of
their set. In a partition of sets of up to ``u`` shingles an item's sketch is its
``floor((1 - t) * u) + SPARE`` least hashes: a random sample of its shingles, so that the share of it that a
document holds estimates the containment. Hashes that over ``COMMON_ITEMS`` items have come after all
others, so a phrase which many items share draws documents only where an item has little else (the sample
is one of its own phrases then). The documents' shingle hashes probe the sketches. An item of ``n``
shingles can lack ``floor((1 - t) * n)`` of them in a document that holds a share ``t``; a candidate whose
sketch lacks more cannot reach ``t`` and goes, so no sketch, however drawn, loses a match. Candidates are
verified exactly, by all shingles of the item in the document, held as 64-bit hashes.

Items of fewer words than a shingle are one shingle of that many words, and are looked for among the
documents' shingles of that length too. A document's words are one array, so the longest text sets the
size of the largest row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import bloom
from framewright.llm.exact_dedup import lower_ascii
from framewright.llm.joins import column_of
from framewright.llm.lineage import cut

#: Ends of the size partitions: sets of up to so many shingles.
SIZES = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Hashes of a sketch beyond those that an item may lack.
SPARE = 3
#: A hash of more items than this is common.
COMMON_ITEMS = 16
#: Items' hashes are broadcast while they are no more than this (16 bytes each); beyond it they shuffle.
BROADCAST_ROWS = 2_000_000


def word_array(text: Column) -> Column:
    """Words (runs of anything but blanks and 0x09-0x0D), A-Z lower-cased; null as empty."""
    return F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all ``size``-word shingles; none of a shorter sequence."""
    at = F.sequence(F.lit(1), F.size(words) - (size - 1))
    every = F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(size)]))
    return F.when(F.size(words) >= size, every).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, size: int, percent: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n, least, hash, kept): the distinct shingle hashes of each item, how many words they
    have, how many of the sketch a document must hold, and whether the sketch has them."""
    made = items.select(column_of(id_col).alias("item_id"), word_array(column_of(text_col)).alias("w")).filter(F.col("item_id").isNotNull())
    length = F.least(F.size("w"), F.lit(size))
    own = shingle_hashes(F.col("w"), size)
    for k in range(size - 1, 0, -1):
        own = F.when(length == k, shingle_hashes(F.col("w"), k)).otherwise(own)
    rows = cut(made.select("item_id", length.alias("words"), F.explode(own).alias("hash")).distinct())
    often = rows.groupBy("hash").agg(F.count("*").alias("often"))
    common = (F.col("often") > COMMON_ITEMS).alias("common")
    sets = rows.join(often, "hash").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(common, "hash", "words"))).alias("set"))
    n = F.size("set")
    upper = F.greatest(n, F.lit(SIZES[-1]))
    for end in reversed(SIZES):
        upper = F.when(n <= end, F.lit(end)).otherwise(upper)
    keep = F.least(F.floor(upper * (100 - percent) / 100) + SPARE, n)
    least = F.greatest(F.lit(1), keep - F.floor(n * (100 - percent) / 100))
    sets = sets.withColumns({"n": n, "keep": keep, "least": least}).select("item_id", "n", "keep", "least", F.posexplode("set").alias("pos", "s"))
    return sets.select("item_id", F.col("s.words").alias("words"), "n", "least", F.col("s.hash").alias("hash"), (F.col("pos") < F.col("keep")).alias("kept"))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): each document and item of which it holds at least
    ``percent`` of the distinct ``size``-word shingles.

    An item of fewer words is one shingle, its whole sequence, and found wherever a text has that
    sequence. Items or texts that are null or without words match nothing, nor do rows with null ids.
    Rows that repeat an id count as one text (or item) that holds the shingles of all. Other columns are
    left out, whatever their names; an empty table gives an empty result.
    """
    shingles = cut(item_shingles(items, size, percent))
    n_rows = shingles.count()
    lengths = sorted({r["words"] for r in shingles.select("words").distinct().collect()} | {size})  # up to ``size``
    texts = docs.select(column_of(id_col).alias("doc_id"), column_of(text_col).alias("text")).filter(F.col("doc_id").isNotNull())

    def met(frame: DataFrame, some: DataFrame) -> DataFrame:
        """Rows of ``some`` by each document that holds their hash, for each place that does."""
        rows = frame.select("doc_id", word_array(F.col("text")).alias("w"))
        each = [
            rows.select("doc_id", F.explode(shingle_hashes(F.col("w"), k)).alias("hash")).join(
                _maybe_broadcast(some.filter(F.col("words") == k).drop("words"), n_rows), "hash"
            )
            for k in lengths
        ]
        return reduce(DataFrame.unionByName, each)

    found = met(texts, shingles.filter("kept").select("words", "hash", "item_id", "least"))
    found = found.groupBy("doc_id", "item_id", "least").agg(F.count_distinct("hash").alias("hits"))
    found = cut(found.filter("hits >= least").select("doc_id", "item_id"))
    ids = found.select("doc_id").distinct()
    # The second reading: only candidates' texts are cut into shingles again.
    bits = bloom.bits_for(found.count())
    pages = bloom.members(ids.select(F.xxhash64("doc_id").alias("_key")), "_key", bits)
    some = bloom.probe(texts.withColumn("_key", F.xxhash64("doc_id")), "_key", pages, bits, "_in").filter("_in")
    held = met(some, shingles.select("words", "hash", "item_id", "n"))
    held = held.groupBy("doc_id", "item_id", F.col("n").alias("n_item")).agg(F.count_distinct("hash").alias("n_shared"))
    held = held.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return held.join(found, ["doc_id", "item_id"], "left_semi")


def mark_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ``contaminated``, ``n_items`` and ``item_ids`` (sorted)."""
    per_doc = matches(docs, items, size, percent, id_col, text_col).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(column_of(id_col).alias("doc_id")).join(per_doc, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast(per_doc.schema["item_ids"].dataType))
    return rows.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were whatever their names. Rows with a
    null id stay."""
    return bloom.without(docs, id_col, matches(docs, items, size, percent, id_col, text_col).select("doc_id"))
