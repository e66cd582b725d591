"""A table with a key, kept in hash buckets and versions: the sink of the queue, metadata, audit and signatures.

A change reads and rewrites the buckets it touches and no other. ``KeyedWriter`` is a Python data source writer:
each task stages Parquet files of its own and reports them; ``commit`` then writes one small version file that names
the files of every bucket, ``abort`` removes what was staged. A reader goes by a version file, so it sees a
change as a whole or not at all, and a failed job leaves the version before it as it was. A commit finds its
base version superseded where someone else wrote in between, and fails: nothing is merged unseen.

Layout: ``<path>/_versions/<number>.json`` and ``<path>/data/<bucket>-<unique>.parquet``, in a folder that driver
and executors share (any store that Arrow's file systems open). Changed rows are staged once below
``<path>/_staged``, so what decides the buckets is what is written. A bucket is rewritten by one task: choose
as many buckets as give files of some 128 MB.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The most buckets of a table: a version file names the files of each.
MOST_BUCKETS = 1 << 16
#: Rows and bytes that a task gathers for a row group, and rows that a bucket is given by ``buckets_for``.
_GROUP_ROWS, _GROUP_BYTES, _BUCKET_ROWS = 1 << 17, 16 << 20, 1 << 18
_BUCKET = "_bucket"


def buckets_for(rows: int, least: int = 16) -> int:
    """How many buckets a table of about so many rows takes, so that a task's share doesn't grow with it."""
    return min(MOST_BUCKETS, max(least, -(-rows // _BUCKET_ROWS)))


class Conflict(RuntimeError):
    """Another writer committed since the version that a change was made from."""


def _store(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path) if ":" in path else (pa_fs.LocalFileSystem(), path)


@dataclass
class Version:
    """What one version of a table consists of."""

    number: int
    key: str
    buckets: int
    schema: dict
    files: dict[str, list[str]] = field(default_factory=dict)  # by bucket
    counters: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream that is in

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


def _version_file(root: str, number: int) -> str:
    return posixpath.join(root, "_versions", f"{number:020d}.json")


def _numbers(fs: pa_fs.FileSystem, root: str) -> list[int]:
    found = fs.get_file_info(pa_fs.FileSelector(posixpath.join(root, "_versions"), allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def _load(fs: pa_fs.FileSystem, root: str, number: int) -> Version:
    with fs.open_input_stream(_version_file(root, number)) as f:
        return Version(**json.loads(f.read()))


def _save(fs: pa_fs.FileSystem, root: str, version: Version) -> None:
    """Writes a version file beside its place and moves it there once it is whole."""
    fs.create_dir(posixpath.join(root, "_versions"))
    if fs.get_file_info(_version_file(root, version.number)).type != pa_fs.FileType.NotFound:
        raise Conflict(f"version {version.number} of {root} exists")
    made = posixpath.join(root, "_versions", f".{uuid.uuid4().hex}")
    with fs.open_output_stream(made) as f:
        f.write(json.dumps(version.__dict__).encode())
    fs.move(made, _version_file(root, version.number))


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # bucket, file, rows


class KeyedSink(DataSource):
    """``format("keyed_table")`` for rows with a bucket column; used through ``KeyedTable``.

    Options: path, base (version that the rows were made from), mode (``replace``: the files of ``touched`` buckets
    give way to the staged ones; ``append``: they are added), touched, counter (JSON of a column whose
    values are numbered and the last number before these rows), batch (JSON of a stream's name and batch number).
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def writer(self, schema: T.StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(dict(self.options))


class KeyedWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str]):
        self.options = options
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        fs, root = _store(self.path)
        fs.create_dir(posixpath.join(root, "data"))
        done: list[tuple[int, str, int]] = []
        writer, bucket, name, rows = None, None, "", 0
        held: list[pa.Table] = []

        def flush() -> None:
            if held:
                writer.write_table(pa.concat_tables(held))
                held.clear()

        try:
            for batch in iterator:
                buckets = batch.column(batch.schema.get_field_index(_BUCKET))
                data = pa.Table.from_batches([batch]).drop_columns([_BUCKET])
                ends = pc.run_end_encode(buckets) if len(buckets) else None
                at = 0
                for b, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True) if ends else ():
                    if b != bucket:
                        if writer:
                            flush()
                            writer.close()
                            done.append((bucket, name, rows))
                        bucket, rows, name = b, 0, f"data/{b:05d}-{uuid.uuid4().hex}.parquet"
                        writer = pq.ParquetWriter(posixpath.join(root, name), data.schema, filesystem=fs)
                    held.append(data.slice(at, end - at))
                    if sum(t.num_rows for t in held) >= _GROUP_ROWS or sum(t.nbytes for t in held) >= _GROUP_BYTES:
                        flush()
                    rows += end - at
                    at = end
            if writer:
                flush()
                writer.close()
                done.append((bucket, name, rows))
        except BaseException:
            if writer:
                writer.close()
            _remove(fs, root, [*(n for _, n, _ in done), name])
            raise
        return _Staged(done)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, root = _store(self.path)
        staged = [f for m in messages if m for f in m.files]
        base = int(self.options["base"])
        if _numbers(fs, root)[-1] != base:
            _remove(fs, root, [n for _, n, _ in staged])
            raise Conflict(f"version {base} of {root} is no longer the last")
        old = _load(fs, root, base)
        files = {b: list(f) for b, f in old.files.items()}
        if self.options["mode"] == "replace":
            for b in json.loads(self.options["touched"]):
                files.pop(str(b), None)
        for b, name, _ in staged:
            files.setdefault(str(b), []).append(name)
        counters, batches = dict(old.counters), dict(old.batches)
        if self.options.get("counter"):
            column, after = json.loads(self.options["counter"])
            counters[column] = after + sum(n for _, _, n in staged)
        if self.options.get("batch"):
            stream, number = json.loads(self.options["batch"])
            batches[stream] = number
        _save(fs, root, Version(base + 1, old.key, old.buckets, old.schema, files, counters, batches))

    def abort(self, messages: list[_Staged | None]) -> None:
        fs, root = _store(self.path)
        _remove(fs, root, [n for m in messages if m for _, n, _ in m.files])


def _remove(fs: pa_fs.FileSystem, root: str, names: Sequence[str]) -> None:
    for name in names:
        full = posixpath.join(root, name)
        if name and fs.get_file_info(full).type == pa_fs.FileType.File:
            fs.delete_file(full)


class KeyedTable:
    """A handle on a table; every change gives the number of the version it made (the old one if nothing changed)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.root = _store(path)
        spark.dataSource.register(KeyedSink)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 64) -> KeyedTable:
        """A new table without rows; the key and the number of buckets stay."""
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")
        columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if key not in columns.names or _BUCKET in columns.names:
            raise ValueError(f"a schema with {key!r} and without {_BUCKET!r}")
        table = cls(spark, path)
        if _numbers(table.fs, table.root):
            raise Conflict(f"{path} holds a table")
        _save(table.fs, table.root, Version(0, key, buckets, json.loads(columns.json())))
        return table

    def version(self, number: int | None = None) -> Version:
        return _load(self.fs, self.root, _numbers(self.fs, self.root)[-1] if number is None else number)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version (the last one)."""
        return self._rows(self.version(number))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        now = self.version()
        held = keys.select(F.col(now.key)).distinct()
        return self._rows(now, self._touched(held, now)).join(held, now.key, "left_semi")

    def upsert(self, new: DataFrame, keep_first: Sequence[str] = (), order: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """``new`` rows replace those of their keys. Columns of ``keep_first`` stay as first inserted, columns that ``new``
        lacks become null; of several new rows of a key the last by ``order`` counts (without one: any). Null keys are
        refused. ``batch`` (a stream's name and batch number) makes a change that comes again one that does nothing."""
        now = self.version()
        if self._is_in(now, batch):
            return now.number
        fixed = self._staged(self._latest(self._shaped(new, now, order), now.key, keep_first, "_rank"))
        touched = self._touched(fixed, now)
        if not touched:
            return now.number
        if not any(now.files.get(str(b)) for b in touched):  # nothing to merge with
            return self._write(self._bucketed(fixed, now).repartition(self._tasks(touched), _BUCKET), now, touched, "replace", batch=batch)
        old = self._rows(now, touched)
        both = self._bucketed(old.withColumn("_rank", F.lit(0)).unionByName(fixed.withColumn("_rank", F.lit(1))), now)
        dealt = both.repartition(self._tasks(touched), _BUCKET)
        return self._write(self._latest(dealt, now.key, keep_first, "_rank", [_BUCKET]), now, touched, "replace", batch=batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Without the rows of the keys."""
        now = self.version()
        if self._is_in(now, batch):
            return now.number
        gone = self._staged(keys.select(F.col(now.key)).filter(F.col(now.key).isNotNull()).distinct())
        touched = self._touched(gone, now)
        if not touched:
            return now.number
        left = self._bucketed(self._rows(now, touched).join(gone, now.key, "left_anti"), now)
        return self._write(left.repartition(self._tasks(touched), _BUCKET), now, touched, "replace", batch=batch)

    def insert_new(self, new: DataFrame, number: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Adds rows whose keys the table doesn't hold, one for each key; known keys stay as they are and no bucket is
        rewritten. ``number`` names a column of ids that follow the largest one given so far."""
        now = self.version()
        if self._is_in(now, batch):
            return now.number
        columns = [c for c in new.columns if c in now.columns.names]
        one = new.select(*columns).filter(F.col(now.key).isNotNull()).distinct()  # by hash, so what follows sorts less
        rest = [c for c in columns if c != now.key]
        least = F.min_by(F.struct(*rest), F.struct(*rest)).alias("_r") if rest else None  # beside ``min`` Spark drops the distinct
        some = self._staged(one.groupBy(now.key).agg(least).select(now.key, "_r.*") if rest else one)
        touched = self._touched(some, now)
        if not touched:
            return now.number
        # The table's keys grow with it: they are shuffled, also where they are few enough for a broadcast.
        unknown = some.join(self._rows(now, touched).select(now.key).hint("merge"), now.key, "left_anti")
        return self._append(unknown, now, number, batch)

    def append(self, new: DataFrame, number: str, batch: tuple[str, int] | None = None) -> int:
        """Adds all rows, numbered in column ``number`` (the table's key) on from the last."""
        now = self.version()
        if self._is_in(now, batch):
            return now.number
        return self._append(new.select(*[c for c in new.columns if c in now.columns.names and c != number]), now, number, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions but the last ``keep``, and files that none of those names; how many files went. For times when
        no job writes: a running one's staged files are named by no version yet."""
        numbers = _numbers(self.fs, self.root)
        for n in numbers[: -max(1, keep)]:
            self.fs.delete_file(_version_file(self.root, n))
        named = {f for n in numbers[-max(1, keep) :] for files in _load(self.fs, self.root, n).files.values() for f in files}
        there = self.fs.get_file_info(pa_fs.FileSelector(posixpath.join(self.root, "data"), allow_not_found=True))
        lost = [f"data/{f.base_name}" for f in there if f"data/{f.base_name}" not in named]
        _remove(self.fs, self.root, lost)
        if self.fs.get_file_info(posixpath.join(self.root, "_staged")).type == pa_fs.FileType.Directory:
            self.fs.delete_dir(posixpath.join(self.root, "_staged"))
        return len(lost)

    # Each of the following is one step of a change.

    @staticmethod
    def _is_in(now: Version, batch: tuple[str, int] | None) -> bool:
        return batch is not None and now.batches.get(batch[0], -1) >= batch[1]

    def _rows(self, now: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = now.files if buckets is None else {str(b): now.files.get(str(b), []) for b in buckets}
        names = [posixpath.join(self.path, f) for files in wanted.values() for f in files]
        return self.spark.read.schema(now.columns).parquet(*names) if names else self.spark.createDataFrame([], now.columns)

    def _bucketed(self, df: DataFrame, now: Version) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(now.key), F.lit(now.buckets)).cast("int"))

    def _touched(self, df: DataFrame, now: Version) -> list[int]:
        """At most as many as there are buckets."""
        return sorted(r[0] for r in self._bucketed(df, now).select(_BUCKET).distinct().collect())

    def _tasks(self, touched: Sequence[int]) -> int:
        return max(1, min(len(touched), 4 * self.spark.sparkContext.defaultParallelism))

    def _shaped(self, new: DataFrame, now: Version, order: Column | None) -> DataFrame:
        have = set(new.columns)
        columns = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in now.columns]
        rank = order if order is not None else F.lit(0)
        return new.select(*columns, rank.alias("_rank")).withColumn(now.key, F.when(F.col(now.key).isNotNull(), F.col(now.key)).otherwise(F.raise_error(F.lit(f"null {now.key}"))))

    @staticmethod
    def _latest(df: DataFrame, key: str, keep_first: Sequence[str], rank: str, beside: Sequence[str] = ()) -> DataFrame:
        """One row for each key, summed up before any shuffle: the last by rank, ``keep_first`` columns of the first."""
        values = [c for c in df.columns if c not in (key, rank, *beside)]
        parts = [(fn, [c for c in values if (c in keep_first) == first]) for fn, first in ((F.max_by, False), (F.min_by, True))]
        aggs = [fn(F.struct(*some), rank).alias(f"_{k}") for k, (fn, some) in enumerate(parts) if some]
        if not aggs:
            return df.select(*beside, key).distinct()
        made = {c: F.col(f"_{k}")[c].alias(c) for k, (_, some) in enumerate(parts) for c in some}
        return df.groupBy(*beside, key).agg(*aggs).select(*[made.get(c, c) for c in df.columns if c != rank])

    def _staged(self, df: DataFrame) -> DataFrame:
        """``df`` computed once; ``vacuum`` removes what is left of it."""
        path = posixpath.join(self.path, "_staged", uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _append(self, new: DataFrame, now: Version, number: str | None, batch: tuple[str, int] | None) -> int:
        rows, counter = self._staged(new), None
        if number:
            after = now.counters.get(number)
            if after is None:  # the first numbers follow those that came with rows
                after = self._rows(now).agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
            rows, counter = self._numbered(rows, number, after), (number, after)
        shaped = self._bucketed(self._shaped(rows, now, None).drop("_rank"), now)
        touched = self._touched(shaped, now)
        if not touched:
            return now.number
        return self._write(shaped.repartition(self._tasks(touched), _BUCKET), now, touched, "append", counter, batch)

    @staticmethod
    def _numbered(rows: DataFrame, column: str, after: int) -> DataFrame:
        """Numbers by place in the staged files: a count for each file, then a row's index in its own. No task orders
        rows, and a task that runs again gives the same numbers."""
        sized = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("_n"))
        ends, total = {}, after
        for r in sorted(sized.collect(), key=lambda r: r["_file"]):  # a row for each task that staged
            ends[r["_file"]] = total
            total += r["_n"]
        if not ends:
            return rows.withColumn(column, F.lit(None).cast("long"))
        first = rows.sparkSession.createDataFrame(list(ends.items()), "_file string, _before bigint")
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        joined = placed.join(F.broadcast(first), "_file")
        return joined.withColumn(column, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")

    def _write(self, rows: DataFrame, now: Version, touched: Sequence[int], mode: str, counter: tuple[str, int] | None = None, batch: tuple[str, int] | None = None) -> int:
        options = {"path": self.path, "base": str(now.number), "mode": mode, "touched": json.dumps(list(touched)), "counter": json.dumps(counter) if counter else "", "batch": json.dumps(batch) if batch else ""}
        ordered = rows.select(*now.columns.names, _BUCKET).sortWithinPartitions(_BUCKET)
        ordered.write.format("keyed_table").mode("append").options(**options).save()
        return now.number + 1
