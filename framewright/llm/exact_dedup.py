"""Exact dedup by two-pass Bloom filtering, with DataFrame operations only.

Each text is hashed once, to (id, digest, 64-bit key). Pass one over that table counts filter slots,
summed before the shuffle; slots met twice make a Bloom filter of possibly repeated keys (several, each
of bounded size and for a range of keys, where one would fill up). Pass two probes it: rows it doesn't hold are the only ones of their text and pass straight
through. Only the rest shuffle, without their text, and are summed by digest before they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import bloom
from framewright.llm.joins import column_of, hot_join, packed
from framewright.llm.lineage import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Text with A-Z lower-cased, null as empty; texts of ASCII alone take the faster way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text, A-Z lower-cased, in UTF-8."""
    return F.sha2(lower_ascii(text), 256)


def _groups(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_maybe``, whether another may have their digest; ``_keep`` and ``_n`` of each digest met
    again). ``rows``: ``_id`` and ``text_sha256`` beside others, written."""
    flagged = cut(bloom.met_again(rows.withColumn("_key", F.xxhash64("text_sha256")), "_key", total, "_maybe").drop("_key"))
    groups = flagged.filter("_maybe").groupBy("text_sha256").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    # A column of its own for the join's weight, as that is not handed on.
    return flagged, cut(groups.filter("_n > 1").withColumn("_rows", F.col("_n")))


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row: ``keep`` (the id alone unless given) and ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so all null and
    empty texts are one group. Of equal texts the row with the largest id stays; null ids lose to
    any other, and in a group of null ids alone all rows stay. Rows that share both text and id stay
    or go together. A ``keep`` column named like an output is replaced; other names may be anything.
    A text of any length is hashed whole. An empty frame gives an empty frame.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    kept = [c for c in (keep or [id_col]) if c not in made]
    carried = F.struct(*[column_of(c) for c in kept] or [F.lit(1)]).alias("_row")
    rows = cut(df.select(carried, column_of(id_col).alias("_id"), digest(column_of(text_col)).alias("text_sha256")))
    total = rows.count()
    rows, groups = _groups(rows, total)
    maybe = hot_join(rows.filter("_maybe"), groups, ["text_sha256"], "_rows", total)
    lone = {"_keep": F.lit(None).cast(rows.schema["_id"].dataType), "_n": F.lit(None).cast("long")}
    every = rows.filter("not _maybe").withColumns(lone).unionByName(maybe)
    keep_id = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return every.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``mark_copies`` keeps, all their columns as they were whatever their names.

    A second reading of the texts: rows whose digest isn't in the Bloom filter of repeated digests
    pass straight through; only the others meet the groups in a shuffle.
    """
    rows = cut(df.select(column_of(id_col).alias("_id"), digest(column_of(text_col)).alias("text_sha256")))
    total = rows.count()
    _, groups = _groups(rows, total)
    bits = bloom.bits_for(groups.count())
    pages = bloom.members(groups.select(F.xxhash64("text_sha256").alias("_key")), "_key", bits)
    whole = df.select(packed(df).alias("_row"), column_of(id_col).alias("_id"), digest(column_of(text_col)).alias("text_sha256"))
    whole = bloom.probe(whole.withColumn("_key", F.xxhash64("text_sha256")), "_key", pages, bits, "_maybe")
    stays = F.col("_n").isNull() | F.col("_keep").eqNullSafe(F.col("_id"))
    maybe = hot_join(whole.filter("_maybe"), groups, ["text_sha256"], "_rows", total).filter(stays)
    return whole.filter("not _maybe").select("_row.*").unionByName(maybe.select("_row.*"))
