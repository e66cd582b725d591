"""The leased priority queue as pure transforms: each takes a queue frame and returns the next one.

``now`` is a parameter (a column or a timestamp), so a transform gives the same result when a lost
executor's task runs again. Selections are top-k plans; nothing collects the queue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.schemas import DONE, FAILED, IN_FLIGHT

ORDER = [F.desc, F.asc, F.asc]


def _set(df: DataFrame, holds: Column, **values: Column) -> DataFrame:
    return df.withColumns({k: F.when(holds, v.cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items() if k in df.columns})


def _null() -> Column:
    return F.lit(None)


def lease_order() -> list[Column]:
    return [F.desc("priority"), F.asc("scheduled_at"), F.asc("id")]


def due(queue: DataFrame, now: Column) -> DataFrame:
    return queue.filter((F.col("state") == "pending") & (F.col("scheduled_at") <= now))


def next_jobs(queue: DataFrame, now: Column, n: int) -> DataFrame:
    """The n due entries that are leased next; ties go to the smaller id."""
    return due(queue, now).orderBy(*lease_order()).limit(n)


def lease(queue: DataFrame, worker: str, n: int, now: Column, seconds: int) -> DataFrame:
    chosen = F.broadcast(next_jobs(queue, now, n).select(F.col("id").alias("_leased")))  # at most n rows
    joined = queue.join(chosen, F.col("id") == F.col("_leased"), "left")
    expiry = now + F.make_dt_interval(secs=F.lit(seconds))
    return _set(joined, F.col("_leased").isNotNull(), state=F.lit("leased"), worker_id=F.lit(worker), leased_at=now, lease_expires_at=expiry).drop("_leased")


def set_state(queue: DataFrame, job: int, state: str, message: str) -> DataFrame:
    return _set(queue, F.col("id") == job, state=F.lit(state), error_message=F.lit(message))


def requeue_with_backoff(queue: DataFrame, holds: Column, now: Column, delay_seconds: Column, message: Column) -> DataFrame:
    later = now + F.make_dt_interval(secs=delay_seconds)
    return _set(queue, holds, state=F.lit("pending"), retry_count=F.col("retry_count") + 1, scheduled_at=later, error_message=message, worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def expired(now: Column) -> Column:
    return F.col("state").isin(*IN_FLIGHT) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))


def recover_crashed(queue: DataFrame, now: Column) -> DataFrame:
    """Expired leases go back to pending, with one more retry."""
    return _set(queue, expired(now), state=F.lit("pending"), retry_count=F.col("retry_count") + 1, worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def reset_at_start(queue: DataFrame) -> DataFrame:
    """All entries in flight go back to pending; retries stay."""
    return _set(queue, F.col("state").isin(*IN_FLIGHT), state=F.lit("pending"), worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def requeue(queue: DataFrame, job: int, now: Column) -> DataFrame:
    return _set(queue, F.col("id") == job, state=F.lit("pending"), retry_count=F.lit(0), scheduled_at=now, error_message=_null(), worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def pause(queue: DataFrame, job: int) -> DataFrame:
    return _set(queue, F.col("id") == job, state=F.lit("paused"), error_message=F.lit("Paused by user"), worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def ignore(queue: DataFrame, job: int) -> DataFrame:
    return _set(queue, F.col("id") == job, state=F.lit("skipped"), error_message=F.lit("Manually excluded by user"), worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def set_priority(queue: DataFrame, holds: Column, priority: int) -> DataFrame:
    """A leased entry goes back to pending as its priority changes."""
    if not 1 <= priority <= 1000:
        raise ValueError("a priority is from 1 to 1000")
    leased = holds & (F.col("state") == "leased")
    return _set(_set(queue, holds, priority=F.lit(priority)), leased, state=F.lit("pending"), worker_id=_null(), leased_at=_null(), lease_expires_at=_null())


def delete(queue: DataFrame, metadata: DataFrame, ids: Sequence[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the jobs and their metadata; ``ids`` is a short list, or a frame with a column ``id`` of any length."""
    if isinstance(ids, DataFrame):
        gone = ids.select("id")
        return queue.join(gone, "id", "left_anti").select(*queue.columns), metadata.join(gone.withColumnRenamed("id", "queue_id"), "queue_id", "left_anti").select(*metadata.columns)
    return queue.filter(~F.col("id").isin(*ids)), metadata.filter(~F.col("queue_id").isin(*ids))


def enqueue(queue: DataFrame, paths: DataFrame, now: Column, priority: int = 50) -> DataFrame:
    """The queue with paths that it doesn't hold yet; new ids follow its largest.

    Paths are made distinct and the known ones left out before ids are given; ids follow blocks of a
    hash (counted per block), so no task numbers all of them.
    """
    new = paths.select("file_path").filter("file_path IS NOT NULL").distinct().join(queue.select("file_path"), "file_path", "left_anti")
    new = number_rows(new, "file_path")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n"))
    filled = {"state": F.lit("pending"), "priority": F.lit(priority), "retry_count": F.lit(0), "created_at": now, "scheduled_at": now}
    columns = [F.col(f.name) if f.name in ("id", "file_path") else filled.get(f.name, _null()).cast(f.dataType).alias(f.name) for f in queue.schema]
    return queue.unionByName(new.select(*columns))


def number_rows(df: DataFrame, key: str, blocks: int = 1024) -> DataFrame:
    """Adds ``_n``, 1 to the number of rows; distinct keys give the same numbers on every run."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block")
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_size"))  # at most ``blocks`` rows
    starts = F.broadcast(starts_of(sizes))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return rows.withColumn("_k", within).join(starts, "_block").withColumn("_n", F.col("_before") + F.col("_k")).drop("_block", "_k", "_before")


def number_in_order(df: DataFrame, order: str, width: int = 1 << 14) -> DataFrame:
    """Adds ``_n``, 1 to the number of rows, in the order of a column of distinct whole numbers. Rows are counted by ranges of
    it first, so no task orders all."""
    rows = df.withColumn("_block", F.floor(F.col(order) / width))
    starts = starts_of(rows.groupBy("_block").agg(F.count("*").alias("_size")))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return rows.withColumn("_k", within).join(starts, "_block").withColumn("_n", F.col("_before") + F.col("_k")).drop("_block", "_k", "_before")


def starts_of(sizes: DataFrame, span: int = 1024) -> DataFrame:
    """(_block, _before): rows in all blocks before each, of (_block, _size). Blocks are summed up by spans first, so no task
    orders more than a span of blocks or all spans."""
    rows = sizes.withColumn("_span", F.floor(F.col("_block") / span))
    so_far = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = rows.groupBy("_span").agg(F.sum("_size").alias("_size")).select("_span", so_far(Window.orderBy("_span")).alias("_first"))
    within = rows.withColumn("_in", so_far(Window.partitionBy("_span").orderBy("_block")))
    return within.join(spans, "_span").select("_block", (F.col("_first") + F.col("_in")).alias("_before"))


def upsert(table: DataFrame, new: DataFrame, key: str, keep_first: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """``new`` rows replace those of the same key; columns of ``keep_first`` stay as first inserted.

    One aggregation by key: of several new rows the last by ``order`` counts.
    """
    rank = order if order is not None else F.lit(0)
    both = table.withColumn("_new", F.lit(0)).withColumn("_rank", F.lit(0).cast(new.select(rank.alias("r")).schema["r"].dataType)).unionByName(new.withColumn("_new", F.lit(1)).withColumn("_rank", rank))
    at = F.struct("_new", "_rank")
    values = [c for c in table.columns if c != key]
    aggs = [(F.min_by if c in keep_first else F.max_by)(F.struct(c), at)[c].alias(c) for c in values]
    return both.groupBy(key).agg(*aggs).select(*table.columns)


def state_filter(group: str) -> Column:
    if group in ("", "all"):
        return F.lit(True)
    return F.col("state").isin(*FAILED) if group == "failed" else F.col("state") == group


def clamp_page(limit: int, offset: int) -> tuple[int, int]:
    return (50 if limit <= 0 else min(limit, 500)), max(0, offset)


def page(queue: DataFrame, group: str = "", limit: int = 100, offset: int = 0, search: str = "") -> DataFrame:
    """Newest entries of a state group; the search looks through the page only, as it comes after the limit."""
    limit, offset = clamp_page(limit, offset)
    found = queue.filter(state_filter(group)).orderBy(F.desc("id")).offset(offset).limit(limit)
    return found.filter(F.lower("file_path").contains(search.lower())) if search else found


def counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("state").agg(F.count("*").alias("n"))


def buckets(queue: DataFrame) -> DataFrame:
    """One row: pending, leased, completed, failed and their sum; entries under review are in none."""
    one = lambda *states: F.coalesce(F.sum(F.when(F.col("state").isin(*states), 1).otherwise(0)), F.lit(0))
    rows = queue.agg(one("pending").alias("pending"), one(*IN_FLIGHT).alias("leased"), one(*DONE).alias("completed"), one(*FAILED).alias("failed"))
    return rows.withColumn("total", F.col("pending") + F.col("leased") + F.col("completed") + F.col("failed"))
