"""Sources: file listings, boundary hashes, probe documents, tool output, configuration."""

from __future__ import annotations

import hashlib
import os
import time
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from framewright.schemas import PROBE


def list_files(spark: SparkSession, scopes: Sequence[str]) -> DataFrame:
    """(path, size, modified) of all files below the scopes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(scopes))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def list_scopes(spark: SparkSession, scopes: Sequence[str], follow_symlinks: bool = False) -> tuple[DataFrame, int]:
    """(path, size, modified, is_link, scope, relative) of the files below each scope that can be listed, by
    ``TreeSource``, and how many scopes cannot: they count as an error and the others go on. Links are left
    out unless they are followed."""
    spark.dataSource.register(TreeSource)
    good = [s for s in scopes if os.path.isdir(s) and os.access(s, os.R_OK | os.X_OK)]
    found = None
    for scope in good:
        rows = spark.read.format("file_tree").option("scopes", scope).option("follow_symlinks", str(follow_symlinks).lower()).load()
        if not follow_symlinks:
            rows = rows.filter("not is_link")
        rows = rows.withColumns({"scope": F.lit(scope), "relative": F.substring("path", F.lit(len(scope.rstrip("/")) + 2), F.length("path"))})
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "path string, size bigint, modified double, is_link boolean, scope string, relative string")
    return found, len(scopes) - len(good)


class TreeSource(DataSource):
    """Listing with link types, as a batch or as a stream that lists anew at each trigger.

    Options: ``scopes`` (comma list), ``follow_symlinks``, ``partitions`` (how many to aim at, 256). Folders are opened, the shallowest
    first, until there are so many to list; so a tree below one folder, or below a long chain of them, is listed by many tasks
    all the same. What is opened for that is bounded by eight times their number. Unreadable folders give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, size bigint, modified double, is_link boolean"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeStream(self.options)


class _Folders(InputPartition):
    """Folders to list: whole trees, and others without the folders in them."""

    def __init__(self, trees: list[str], single: list[str]):
        super().__init__(None)
        self.trees, self.single = trees, single


def _folders(path: str) -> list[str]:
    try:
        with os.scandir(path) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class _Tree:
    def __init__(self, options: Mapping[str, str]):
        self.scopes = [s for s in options.get("scopes", "").split(",") if s]
        self.follow = options.get("follow_symlinks", "false").lower() == "true"
        self.most = max(1, int(options.get("partitions", "256")))

    def split(self) -> list[InputPartition]:
        trees, single = deque(self.scopes), []
        while trees and len(trees) < self.most and len(single) < 8 * self.most:
            path = trees.popleft()
            single.append(path)
            trees.extend(_folders(path))
        n = min(self.most, max(1, len(trees) + len(single)))
        dealt = list(trees)
        return [_Folders(dealt[k::n], single[k::n]) for k in range(n)]

    def list(self, part: _Folders) -> Iterator[tuple]:
        stack = [(p, False) for p in part.single] + [(p, True) for p in part.trees]
        while stack:
            path, deep = stack.pop()
            try:
                entries = sorted(os.scandir(path), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                link = e.is_symlink()
                if e.is_dir(follow_symlinks=False):
                    if deep:
                        stack.append((e.path, True))
                elif (not link or self.follow) and e.is_file():
                    s = e.stat()
                    yield e.path, s.st_size, s.st_mtime, link


class _TreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.tree = _Tree(options)

    def partitions(self) -> list[InputPartition]:
        return self.tree.split()

    def read(self, partition: _Folders) -> Iterator[tuple]:
        return self.tree.list(partition)


class _TreeStream(DataSourceStreamReader):
    """An offset is the time of a listing: each trigger has one later than the last, so each lists the trees."""

    def __init__(self, options: Mapping[str, str]):
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"listed_ms": 0}

    def latestOffset(self) -> dict:
        return {"listed_ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.tree.split()

    def read(self, partition: _Folders) -> Iterator[tuple]:
        return self.tree.list(partition)


def boundary_hashes(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Adds SHA-256 of the first and last ``block`` bytes by seeking: at most two blocks of a file are
    read, whatever its size. Files that can't be read get nulls."""
    schema = T.StructType([*files.schema.fields, T.StructField("first_hash", T.StringType()), T.StructField("last_hash", T.StringType())])

    def one(path: str) -> tuple[str | None, str | None]:
        try:
            with open(path.removeprefix("file:"), "rb") as f:
                first = hashlib.sha256(f.read(block)).hexdigest()
                size = f.seek(0, 2)
                if size <= block:
                    return first, first
                f.seek(size - block)
                return first, hashlib.sha256(f.read(block)).hexdigest()
        except OSError:
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(p) for p in b["path"]]
            yield b.assign(first_hash=[m[0] for m in made], last_hash=[m[1] for m in made])

    return files.mapInPandas(run, schema)


def read_probe_files(spark: SparkSession, path: str) -> DataFrame:
    """One probe document for each file."""
    return spark.read.schema(PROBE).option("multiLine", True).json(path)


def encoder_names(spark: SparkSession, path: str) -> DataFrame:
    """The second field of each line of an encoder listing."""
    fields = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).select(F.get(fields, F.lit(1)).alias("encoder")).filter("encoder IS NOT NULL")


def progress_lines(text: DataFrame, col: str = "value") -> DataFrame:
    """Lines of tool output, which end in line feeds or carriage returns."""
    return text.withColumn("line", F.explode(F.split(F.col(col), "[\\r\\n]+"))).filter("line <> ''")
