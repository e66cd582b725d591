"""Inventory of a file tree as columns: depth, exclusions, suffix, extensions, and the scan report."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import scalar as S


def glob_regex(glob: str) -> str:
    """Shell pattern as a regular expression over a whole base name (``*``, ``?``, ``[...]``)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def excluded(path: Column, globs: Sequence[str]) -> Column:
    name = S.base_name(path)
    hit = F.lit(False)
    for g in globs:
        hit = hit | name.rlike(glob_regex(g))
    return hit


def already_processed(path: Column, suffix: str = "_crunched") -> Column:
    return F.lower(S.stem(path)).endswith(suffix)


def wanted_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Empty list: all. Leading dots and case don't matter."""
    names = [e.strip().lower().lstrip(".") for e in extensions if e.strip()]
    return S.extension(path).isin(["." + e for e in names]) if names else F.lit(True)


def within_depth(relative: Column, most: int) -> Column:
    return F.size(F.split(relative, "/")) - 1 <= most if most > 0 else F.lit(True)


def classify(
    files: DataFrame, globs: Sequence[str] = (), extensions: Sequence[str] = (), suffix: str = "_crunched", path_col: str = "path", relative: Column | None = None, most_depth: int = 0,
) -> DataFrame:
    """Adds ``fate``: deep (``relative`` lies beyond ``most_depth`` folders), excluded, processed, extension or
    accepted, in that order of checks."""
    path = F.col(path_col)
    deep = F.lit(False) if relative is None else ~within_depth(relative, most_depth)
    fate = (
        F.when(deep, "deep").when(excluded(path, globs), "excluded").when(already_processed(path, suffix), "processed")
        .when(~wanted_extension(path, extensions), "extension").otherwise("accepted")
    )
    return files.withColumn("fate", fate)


def report(marked: DataFrame, errors: int = 0) -> DataFrame:
    """One row of counters over rows with ``fate`` and ``is_duplicate``; ``errors`` counts scopes that could
    not be read. Files in folders that are too deep are never met, so they aren't seen."""
    marked = marked.filter("fate <> 'deep'")
    count = lambda holds: F.coalesce(F.sum(F.when(holds, 1).otherwise(0)), F.lit(0))
    taken = F.col("fate") == "accepted"
    return marked.agg(
        F.count("*").alias("seen"),
        count(F.col("fate").isin("excluded", "processed")).alias("excluded"),
        count(F.col("fate") == "extension").alias("other_extension"),
        count(taken & ~F.col("is_duplicate")).alias("accepted"),
        count(taken & F.col("is_duplicate")).alias("duplicates"),
        F.lit(errors).cast("bigint").alias("errors"),
    )


def union_scopes(frames: Sequence[DataFrame]) -> DataFrame:
    """Files of all scopes; a path in several of them counts once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path"])
