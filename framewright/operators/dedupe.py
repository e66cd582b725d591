"""Two-tier duplicate detection of files: by size, then by boundary hashes of those that share one.

Input rows: (path, size, signature, seq). ``signature`` stands for the combined boundary hash; it is
only looked at where a size is shared, so a caller may leave it null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_sizes(files: DataFrame) -> DataFrame:
    """Files that another file's size equals: the only ones worth hashing. Counted before the shuffle."""
    twice = files.groupBy("size").agg(F.count("*").alias("_n")).filter("_n > 1").select("size")
    return files.join(twice, "size", "left_semi")


def mark_duplicates(files: DataFrame, mode: str = "exact") -> DataFrame:
    """Adds ``is_duplicate`` and ``original`` (path of the file it repeats, null for none).

    ``exact``: of equal (size, signature) the first by seq is the original. ``live``: the index of a
    running scan, which stores the first file of each size without its hash, so that equality shows
    from the second on only. Both aggregate by (size, signature) before they shuffle, so a huge group of
    equal files costs one row for each task, and join back groups of two files and more alone. Files of a
    null size or signature repeat none.
    """
    key = ["size", "signature"]
    if mode == "exact":
        seen = files
    elif mode == "live":
        first = files.groupBy("size").agg(F.min("seq").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        files = files.join(first, "size", "left").withColumn("_hidden", F.coalesce(F.col("seq") == F.col("_first"), F.lit(True))).drop("_first")
        seen = files.filter("not _hidden")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    origin = seen.groupBy(*key).agg(F.min(F.struct("seq", "path")).alias("_origin"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    joined = files.join(origin, key, "left")
    later = F.coalesce(F.col("seq") > F.col("_origin.seq"), F.lit(False))
    if mode == "live":
        later = later & ~F.col("_hidden")
    return joined.withColumns({"is_duplicate": later, "original": F.when(later, F.col("_origin.path"))}).drop("_origin", "_hidden")


def load_signatures(rows: DataFrame) -> DataFrame:
    """Stored signatures with their hashes decoded; rows whose base64 is corrupt are left out."""
    decoded = rows.withColumns({c: F.try_to_binary(F.col(c), F.lit("base64")) for c in ("first_mb_hash", "last_mb_hash")})
    return decoded.filter("first_mb_hash IS NOT NULL AND last_mb_hash IS NOT NULL")


def store_signatures(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.base64(c) for c in ("first_mb_hash", "last_mb_hash")})


def signatures_since(rows: DataFrame, since) -> DataFrame:
    return rows.filter(F.col("last_scanned") > F.lit(since)).orderBy(F.desc("last_scanned"))


def upsert_signatures(table: DataFrame, new: DataFrame, now) -> DataFrame:
    """The last row of each path; ``first_seen`` starts anew unless the new row gives it."""
    filled = new.withColumns({"first_seen": F.coalesce("first_seen", now), "last_scanned": now})
    both = table.withColumn("_new", F.lit(0)).unionByName(filled.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "last_scanned")
    return both.groupBy("path").agg(*[F.max_by(F.struct(c), at)[c].alias(c) for c in table.columns if c != "path"]).select(*table.columns)


def delete_signatures(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths, "path", "left_anti")


def unique_sizes(files: DataFrame) -> DataFrame:
    """The number of distinct sizes, which the status report calls unique files."""
    return files.agg(F.count_distinct("size").alias("unique_files"))


def signature_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("signatures"))


def truncate_signatures(table: DataFrame) -> DataFrame:
    return table.limit(0)


def restore_signatures(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files with the signature that is stored for their path and size, where they have none of their own."""
    known = stored.select("path", "size", F.sha2(F.concat("first_mb_hash", "last_mb_hash"), 256).alias("_stored"))
    joined = files.join(known, ["path", "size"], "left")
    return joined.withColumn("signature", F.coalesce("signature", "_stored")).drop("_stored")


def visit(files: DataFrame, fn) -> None:
    """Calls ``fn`` with the rows of each partition, on the executors; nothing is gathered."""
    files.foreachPartition(fn)
