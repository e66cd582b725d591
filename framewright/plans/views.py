"""The driver's tables seen as the library's: files, queue, audit events, results, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    first, last = S.boundary_hashes(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    blocks = S.combined_signature(first, last)
    return d.select(path.alias("path"), F.col("n_chars").alias("size"), blocks.alias("signature"), F.col("doc_id").alias("seq"), "lang")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "leased").otherwise("completed")
    at = F.col("o_orderdate").cast("timestamp")
    leased = F.col("o_orderstatus") == "P"
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("/media/"), F.col("o_orderkey").cast("string"), F.lit(".mkv")).alias("file_path"),
        state.alias("state"), F.when(leased, "w0").alias("worker_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (F.col("o_orderkey") % 4).cast("int").alias("retry_count"), at.alias("created_at"), F.when(leased, at).alias("leased_at"),
        F.when(leased, at + F.expr("INTERVAL 30 MINUTES")).alias("lease_expires_at"), at.alias("scheduled_at"), F.lit(None).cast("string").alias("error_message"),
    )


#: Audit events for event types.
EVENT_NAMES = {"purchase": "job_completed", "error": "job_failed", "signup": "job_quality_failed", "view": "job_skipped_growth", "click": "job_skipped"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("seq_id"), F.col("ts").cast("timestamp").alias("ts"), names[F.col("event_type")].alias("event_type"), F.col("user_id").alias("queue_id"),
        F.col("value").alias("vmaf"), F.floor(F.col("value") * 1000).cast("long").alias("saved_bytes"), F.col("props").alias("payload_json"), "event_id",
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metadata`` of parts: codec by brand, size as height, price as bitrate."""
    p = table(spark, sf_dir, "part")
    height = (F.col("p_size") * 50).cast("int")
    width = F.floor(height * 16 / 9).cast("int")
    meta = F.struct(
        F.lower(F.regexp_extract("p_type", "(\\w+)$", 1)).alias("video_codec"), width.alias("width"), height.alias("height"), S.resolution_tag(width, height).alias("resolution"),
        (F.col("p_retailprice") * 1000).cast("long").alias("bitrate"), (F.col("p_size") % 2 == 0).alias("is_hdr"), (F.col("p_size") % 3 == 0).alias("has_surround"),
    )
    return p.select("p_partkey", "p_brand", "p_type", meta.alias("metadata"))
