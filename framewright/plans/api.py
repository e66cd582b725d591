"""What the daemon's command line and reports answer, as functions over frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import audit, dedupe, evaluate, queue, scan
from framewright.sources import files


def scan_library(
    spark: SparkSession, scopes: Sequence[str], globs: Sequence[str] = (), extensions: Sequence[str] = (), mode: str = "exact", max_depth: int = 0, follow_symlinks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(accepted files of the scopes, marked as duplicates; the scan report). Only files that share a size
    are opened; a scope that cannot be read counts as an error, and a path in several counts once."""
    listed, errors = files.list_scopes(spark, scopes, follow_symlinks)
    listed = listed.dropDuplicates(["path"])
    fates = scan.classify(listed, globs, extensions, relative=F.col("relative"), most_depth=max_depth)
    found = fates.filter("fate = 'accepted'")
    hashed = files.boundary_hashes(dedupe.shared_sizes(found))
    signature = hashed.select("path", F.sha2(F.concat(F.unhex("first_hash"), F.unhex("last_hash")), 256).alias("signature"))
    marked = found.join(signature, "path", "left").withColumn("seq", F.struct("modified", "path"))
    marked = dedupe.mark_duplicates(marked, mode)
    every = fates.join(marked.select("path", "is_duplicate"), "path", "left").fillna(False, ["is_duplicate"])
    return marked, scan.report(every, errors)


def evaluate_library(probes: DataFrame, rules: Sequence[evaluate.Rule], aliases: Mapping[str, str] | None = None, policy: evaluate.AudioPolicy = evaluate.AudioPolicy()) -> DataFrame:
    """Metadata, decision and plan of each probe document; one chain of projections."""
    return evaluate.stream_plan(evaluate.decide(evaluate.normalize(probes, aliases), rules), policy)


def status(jobs: DataFrame, events: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row: bucket counts, average quality and savings of recent jobs, the last events, unique files,
    health. All sides have one row."""
    savings = audit.recent_savings(events).agg(F.sort_array(F.collect_list(F.struct("seq_id", "saved_bytes")), False).alias("recent_savings"))  # 15 at most
    last = audit.newest(events, 20).agg(F.sort_array(F.collect_list(F.struct("seq_id", "event_type")), False).alias("recent_events"))  # 20 at most
    one = queue.buckets(jobs).crossJoin(audit.average_vmaf(events)).crossJoin(savings).crossJoin(last).crossJoin(dedupe.unique_sizes(inventory))
    return one.withColumn("health", F.lit(audit.constant_health()))


def queue_page(jobs: DataFrame, events: DataFrame, progress: DataFrame, group: str = "", limit: int = 100, search: str = "") -> DataFrame:
    """A page of the queue with the latest figures and live progress of each job. The page and the
    figures hold at most 500 and 200 rows, so they are broadcast."""
    stats = audit.latest_job_stats(events).withColumnRenamed("queue_id", "id")
    page = queue.page(jobs, group, limit, 0, search)
    return page.join(F.broadcast(stats), "id", "left").join(progress.withColumnRenamed("job_id", "id"), "id", "left")


def queue_item(jobs: DataFrame, metadata: DataFrame, progress: DataFrame, job: int) -> DataFrame:
    one = jobs.filter(F.col("id") == job)
    return one.join(metadata.filter(F.col("queue_id") == job), one["id"] == F.col("queue_id"), "left").join(progress.filter(F.col("job_id") == job), one["id"] == F.col("job_id"), "left")


def find_scope(scopes: DataFrame, path: str) -> DataFrame:
    return scopes.filter(F.col("path") == path)


def with_scope(scopes: DataFrame, scope: DataFrame) -> DataFrame:
    """Scopes with one more; one of the same path is replaced."""
    return scopes.join(scope.select("path"), "path", "left_anti").unionByName(scope)


def without_scope(scopes: DataFrame, path: str) -> DataFrame:
    return scopes.filter(F.col("path") != path)


def recovered_event(jobs: DataFrame, now: Column) -> DataFrame:
    """The audit row of a recovery, if any job was recovered."""
    n = jobs.filter(queue.expired(now)).agg(F.count("*").alias("n")).filter("n > 0")
    return n.select(now.alias("timestamp"), F.lit("crash_recovery").alias("event_type"), F.lit("warning").alias("severity"), audit.payload(recovered_jobs=F.col("n")).alias("payload_json"))
