"""Structured Streaming without state of its own: file streams, progress lines, windows, and what a micro-batch does.

``stateful`` has the streams with state and timers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar as S
from framewright.operators import audit, evaluate
from framewright.sources import files
from framewright.streaming import stateful

#: Fixed value: seconds between rescans where none are configured.
RESCAN_SECONDS = 20


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of files; ``per_trigger`` is the back pressure of a bounded buffer."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def replay(slices: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], path: str, mode: str = "append") -> DataFrame:
    """What the stream ``make`` gives when ``slices`` of a table arrive one after the other: each is written to the source's folder
    below ``path``, then the query takes all there is and stops, and starts from its checkpoint for the next. In mode ``complete``
    the last result counts. For streams without timers of processing time, which never have done with what there is."""
    spark, schema = slices[0].sparkSession, slices[0].schema
    for part in slices:
        part.write.mode("append").parquet(f"{path}/in")
        out = make(spark.readStream.schema(schema).parquet(f"{path}/in"))
        writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", f"{path}/out").start()
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def rescan(spark: SparkSession, scopes: Sequence[str], follow_symlinks: bool = False) -> DataFrame:
    """(path, size, modified, change): each trigger lists the trees anew, by many tasks, and gives the files that are new or
    changed since. The trigger is the period: ``trigger(processingTime=rescan_period(...))``. A folder that can't be read gives
    no files. What was given stays known over restarts, in the stream's state."""
    spark.dataSource.register(files.TreeSource)
    listing = spark.readStream.format("file_tree").option("scopes", ",".join(scopes)).option("follow_symlinks", str(follow_symlinks).lower()).load()
    return stateful.new_or_changed(listing if follow_symlinks else listing.filter("not is_link"))


def rescan_period(seconds: float) -> str:
    """A trigger's period; one that isn't positive is the default."""
    return f"{int((seconds if seconds > 0 else RESCAN_SECONDS) * 1000)} milliseconds"


def progress_events(output: DataFrame) -> DataFrame:
    """Events for ``stateful.track`` of tool output (job_id, seq, value, total_sec): its last line of progress in each row."""
    lines = files.progress_lines(output).withColumn("p", S.progress_fields(F.col("line"))).filter("p IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    return lines.select(
        "job_id", "seq", F.lit("update").alias("kind"), none("string").alias("phase"), none("string").alias("detail"), F.col("p.frames").alias("frames"), F.col("p.fps").alias("fps"), F.col("p.speed").alias("speed"),
        F.col("p.current_sec").alias("current_sec"), F.col("total_sec").cast("double").alias("total_sec"), F.col("p.bitrate").alias("bitrate"), none("int").alias("segment"), none("int").alias("segments"),
    )


def with_fresh_rules(load_rules: Callable[[], list], then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that decides each micro-batch (with ``metadata``) by the rules as they are
    when it begins."""

    def run(batch: DataFrame, batch_id: int) -> None:
        then(evaluate.decide(batch, load_rules()), batch_id)

    return run


def batches_by_time(events: DataFrame, seconds: int, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Event-time windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("window")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "job_completed", 1).otherwise(0)).alias("completed"), F.sum(F.coalesce("saved_bytes", F.lit(0))).alias("saved_bytes")
    )


def notify(channels: Sequence[audit.Channel], send: Callable[[audit.Channel, DataFrame], None], records_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for ``stateful.batches``: each batch of events becomes a summary, is rendered for every channel that
    takes summaries, sent channel by channel, and recorded.

    ``send`` gets a channel and its messages (event_id, body, signature) and raises ``OSError`` or ``RuntimeError`` where the channel
    fails: that channel's records say so, and its summaries become dead letters, while the others go on; any other error stops
    the stream. Records and dead letters of a micro-batch are one folder, written anew when it runs again, so none is
    there twice; a channel may get a message again then.
    """

    def run(batch: DataFrame, number: int) -> None:
        event = F.concat(F.lit(f"batch-{number}-"), F.hex(F.monotonically_increasing_id()))
        mean = F.when(F.col("vmaf_n") > 0, F.col("vmaf_sum") / F.col("vmaf_n")).otherwise(0.0)
        summaries = batch.withColumns({"event_id": event, "avg_vmaf": mean, "timestamp": F.current_timestamp()})
        out = audit.outbox(summaries, channels).persist()
        try:
            results = {}
            for c in channels:
                mine = out.filter(F.col("channel") == c.name)
                if mine.isEmpty():
                    continue
                try:
                    send(c, mine.select("event_id", "body", "signature"))
                    results[c.name] = (audit.DELIVERED, audit.ACCEPTED)
                except (OSError, RuntimeError) as error:
                    results[c.name] = (audit.UNDELIVERED, str(error))
            if not results:
                return
            told = F.create_map(*[x for name, (status, response) in results.items() for x in (F.lit(name), F.struct(F.lit(status).alias("status"), F.lit(response).alias("response")))])
            rows = out.withColumns({"told": told[F.col("channel")], "id": F.xxhash64("event_id", "channel"), "now": F.current_timestamp()})
            rows.select("id", "event_id", "channel", "told.status", "told.response", F.col("now").alias("timestamp")).write.mode("overwrite").parquet(f"{records_path}/batch={number}")
            dead = rows.filter(F.col("told.status") == audit.UNDELIVERED)
            dead.select("id", F.col("payload").alias("event_json"), F.lit(0).alias("retry_count"), F.col("told.response").alias("last_error"), F.col("now").alias("created_at")).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        finally:
            out.unpersist()

    return run
