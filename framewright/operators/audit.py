"""Audit analytics, status, metrics, notifications and schedules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import scalar as S
from framewright.operators.queue import number_in_order, number_rows, starts_of
from framewright.schemas import PAYLOAD

#: Audit events that carry a job's figures.
STAT_EVENTS = ("job_completed", "job_quality_failed", "job_skipped_growth")
#: States of a delivery record, and its response where a channel took the message.
DELIVERED, UNDELIVERED, ACCEPTED = "delivered", "failed", "OK"


def parse_payload(audit: DataFrame, schema=PAYLOAD, col: str = "payload_json") -> DataFrame:
    return audit.withColumn("payload", F.from_json(F.col(col), schema))


def payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))



@dataclass(frozen=True)
class Channel:
    """A channel of notifications: its kind decides what a message looks like; no events means all of them."""

    name: str
    kind: str
    events: tuple[str, ...] = ()
    secret: str | None = None


#: The fields of an audit event's payload, by the event of an outcome.
OUTCOME_FIELDS = {
    "job_skipped": ("queue_id", "action", "size", "reason"),
    "job_copied": ("queue_id", "action", "size"),
    "job_pixfmt_review": ("queue_id", "pix_fmt", "chroma", "bit_depth", "reason"),
    "job_skipped_precheck": ("queue_id", "vmaf", "ssim", "preset"),
    "job_skipped_growth": ("queue_id", "orig_size", "new_size", "reason"),
    "job_quality_failed": ("queue_id", "orig_size", "new_size", "vmaf", "reason"),
    "job_completed": ("queue_id", "orig_size", "new_size", "saved_bytes", "vmaf", "duration", "encoder", "hw"),
    "job_crash": ("queue_id", "error", "crash"),
    "job_failed": ("queue_id", "error"),
}
#: Decimals that figures of a payload are given with.
_DECIMALS = {"vmaf": 2, "duration": 2, "ssim": 4}


def outcome_payload(event_type: Column, fields: dict[str, Column]) -> Column:
    """JSON payload of an outcome's event, of those of ``fields`` that such an event has."""
    case = F.lit(None).cast("string")
    for event, names in OUTCOME_FIELDS.items():
        some = {k: F.round(fields[k], _DECIMALS[k]) if k in _DECIMALS else fields[k] for k in names if k in fields}
        case = F.when(event_type == event, payload(**some)).otherwise(case)
    return case


def append_events(audit: DataFrame, new: DataFrame, now: Column, order: str | None = None) -> DataFrame:
    """The log with ``new`` (event_type, severity, payload_json) after it, numbered on from its last event, in
    the order of column ``order`` (distinct whole numbers), without one in no promised order. An empty severity is ``info``. ``sources.keyed.KeyedTable.append`` does the same for a stored log."""
    last = audit.agg(F.coalesce(F.max("seq_id"), F.lit(0)).alias("_last"))  # one row
    numbered = number_in_order(new, order) if order else number_rows(new.withColumn("_key", F.struct("event_type", "severity", "payload_json")), "_key")
    rows = numbered.crossJoin(F.broadcast(last))
    rows = rows.select((F.col("_last") + F.col("_n")).cast("bigint").alias("seq_id"), now.alias("timestamp"), "event_type", F.coalesce(F.nullif("severity", F.lit("")), F.lit("info")).alias("severity"), "payload_json")
    return audit.select(*rows.columns).unionByName(rows)


def newest(audit: DataFrame, n: int) -> DataFrame:
    """The last n events; 20 when n isn't positive."""
    return audit.orderBy(F.desc("seq_id")).limit(n if n > 0 else 20)


def average_vmaf(audit: DataFrame, n: int = 15) -> DataFrame:
    top = newest(audit, n).filter("event_type = 'job_completed'")
    v = F.col("vmaf")
    return top.agg(F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)).alias("avg_vmaf"))


def recent_savings(audit: DataFrame, n: int = 15) -> DataFrame:
    return newest(audit, n).filter("event_type = 'job_completed' AND saved_bytes > 0").select("seq_id", "saved_bytes")


def latest_job_stats(audit: DataFrame, n: int = 200) -> DataFrame:
    """The latest figures of each job among the newest n events (the report looks no further)."""
    recent = newest(audit, n).filter(F.col("event_type").isin(*STAT_EVENTS) & (F.col("queue_id") > 0))
    last = Window.partitionBy("queue_id").orderBy(F.desc("seq_id"))
    return recent.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def latest_by_job(audit: DataFrame) -> DataFrame:
    """The latest figures of every job, by an aggregation that sums up before its shuffle."""
    some = audit.filter(F.col("event_type").isin(*STAT_EVENTS) & (F.col("queue_id") > 0))
    return some.groupBy("queue_id").agg(F.max_by(F.struct(*[c for c in audit.columns if c != "queue_id"]), "seq_id").alias("s")).select("queue_id", "s.*")


def batch_summary(events: DataFrame, key: str) -> DataFrame:
    """Figures of each batch: all events, ``job_completed`` and ``job_failed`` ones, and of the completed
    the bytes saved and the mean of scores above 0 (0 without any)."""
    done = F.col("event_type") == "job_completed"
    return events.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.when(done, 1).otherwise(0)).alias("completed"),
        F.sum(F.when(F.col("event_type") == "job_failed", 1).otherwise(0)).alias("failed"),
        F.sum(F.when(done, F.coalesce("saved_bytes", F.lit(0))).otherwise(0)).alias("saved_bytes"),
        F.coalesce(F.avg(F.when(done & (F.col("vmaf") > 0), F.col("vmaf"))), F.lit(0.0)).alias("avg_vmaf"),
    )


def summary_message(batches: DataFrame) -> DataFrame:
    """Adds what channels get of a batch's figures: ``event_type`` (batch_summary), ``title``, ``message``."""
    message = F.format_string("Batch finished: %d completed, %d failed. Saved: %s", "completed", "failed", S.format_bytes(F.col("saved_bytes")))
    return batches.withColumns({"event_type": F.lit("batch_summary"), "title": F.format_string("Transcode Batch: %d processed", "n"), "message": message})


def outbox(summaries: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """What each channel is to send of each summary that it takes: event_id, channel, kind, body, signature, and ``payload``,
    the summary as a document.

    Summaries: event_id, n, completed, failed, saved_bytes, avg_vmaf, timestamp. Channels are configuration; each kind is rendered
    once, for those of its channels whose list of events is empty or holds ``batch_summary``. A channel that signs its bodies
    is rendered by itself.
    """
    if len(channels) > 1000:
        raise ValueError("more than 1,000 channels")
    messages, out = render_message("webhook", summary_message(summaries)).withColumnRenamed("body", "payload"), None
    takers: dict[tuple, list[str]] = {}
    for c in channels:
        if not c.events or "batch_summary" in c.events:
            takers.setdefault((c.kind, c.secret if c.kind == "webhook" else None), []).append(c.name)
    for (kind, secret), names in takers.items():
        made = render_message(kind, messages, secret)
        signature = F.col("signature") if kind == "webhook" and secret else F.lit(None).cast("string")
        rows = made.select("event_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("channel"), F.lit(kind).alias("kind"), "body", signature.alias("signature"), "payload")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = F.lit("")
        out = messages.limit(0).select("event_id", *[empty.alias(c) for c in ("channel", "kind", "body", "signature")], "payload")
    return out


def within_rate(messages: DataFrame, per_minute: int, channel: str = "channel", ts: str = "timestamp") -> DataFrame:
    """The first ``per_minute`` messages of each channel in each minute, by time; all where it isn't positive."""
    if per_minute <= 0:
        return messages
    order = Window.partitionBy(channel, F.date_trunc("minute", ts)).orderBy(ts, "event_id")
    return messages.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_minute).drop("_rank")


def count_batches(events: DataFrame, size: int, order: str = "seq_id") -> DataFrame:
    """Adds ``batch``: every ``size`` events in order. Numbers are given by ranges of ``order``: a count
    for each range first, then within each, so no task numbers all events."""
    width = 1 << 14
    rows = events.withColumn("_block", F.floor(F.col(order) / width))
    starts = starts_of(rows.groupBy("_block").agg(F.count("*").alias("_size")))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    numbered = rows.withColumn("_k", within).join(starts, "_block")
    return numbered.withColumn("batch", F.floor((F.col("_before") + F.col("_k") - 1) / size).cast("long")).drop("_block", "_k", "_before")


def time_batches(events: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    return events.withColumn("batch", F.window(ts, f"{seconds} seconds")["start"])


def for_channels(summaries: DataFrame, channels: DataFrame, batch_type: str = "batch_summary") -> DataFrame:
    """Each summary for each channel that takes its type (an empty list takes all). Channels are
    configuration; more than 1,000 are refused rather than broadcast."""
    if channels.count() > 1000:
        raise ValueError("more than 1,000 channels")
    takes = (F.size("events") == 0) | F.array_contains("events", F.lit(batch_type))
    return summaries.crossJoin(F.broadcast(channels.filter(takes)))


def render_message(kind: str, event: DataFrame, secret: str | None = None) -> DataFrame:
    """Adds ``body``, what a channel of that kind sends; the webhook gets ``signature`` too."""
    title, text, ts = F.col("title"), F.col("message"), F.col("timestamp")
    etype = F.col("event_type")
    if kind == "discord":
        fields = F.filter(
            F.array(
                F.when(F.col("saved_bytes") > 0, F.struct(F.lit("Saved").alias("name"), S.format_bytes(F.col("saved_bytes")).alias("value"))),
                F.when(F.col("avg_vmaf") > 0, F.struct(F.lit("VMAF").alias("name"), S.fixed(F.col("avg_vmaf"), 2).alias("value"))),
            ),
            lambda x: x.isNotNull(),
        )
        embed = F.struct(title.alias("title"), text.alias("description"), S.event_color(etype).alias("color"), S.rfc3339(ts).alias("timestamp"), fields.alias("fields"))
        return event.withColumn("body", F.to_json(F.struct(F.array(embed).alias("embeds"))))
    if kind == "telegram":
        extra = F.concat(F.when(F.col("saved_bytes") > 0, F.concat(F.lit("\nSaved: "), S.format_bytes(F.col("saved_bytes")))).otherwise(""), F.when(F.col("avg_vmaf") > 0, F.concat(F.lit("\nVMAF: "), S.fixed(F.col("avg_vmaf"), 2))).otherwise(""))
        return event.withColumn("body", F.concat(F.lit("*"), S.escape_markdown(title), F.lit("*\n"), S.escape_markdown(text), extra))
    if kind == "slack":
        return event.withColumn("body", F.to_json(F.struct(F.concat(F.lit("*"), title, F.lit("*\n"), text).alias("text"))))
    if kind == "gotify":
        return event.withColumn("body", F.to_json(F.struct(title.alias("title"), text.alias("message"), S.gotify_priority(etype).alias("priority"))))
    if kind == "webhook":
        # Figures of 0 are left out of the document, as nulls are.
        some = [F.nullif(F.col(c), F.lit(0)).alias(name) for c, name in (("n", "total_items"), ("saved_bytes", "saved_bytes"), ("avg_vmaf", "average_vmaf")) if c in event.columns]
        own = [F.col("event_id").alias("event_id")] if "event_id" in event.columns else []
        out = event.withColumn("body", F.to_json(F.struct(*own, etype.alias("event_type"), title.alias("title"), text.alias("message"), S.rfc3339(ts).alias("timestamp"), *some)))
        return out.withColumn("signature", S.hmac_sha256(secret, F.col("body"))) if secret else out
    if kind == "smtp":
        return event.withColumn("body", F.concat(F.lit("<h2>"), S.escape_html(title), F.lit("</h2><p>"), S.escape_html(text), F.lit("</p>")))
    raise ValueError(f"unknown channel {kind!r}")


def prometheus(metrics: DataFrame) -> DataFrame:
    """One row of exposition text from (name, type, help, value) rows; floats with two decimals. Metrics
    are few (one for each name)."""
    value = F.when(F.col("value") == F.floor("value"), F.format_string("%d", F.col("value").cast("long"))).otherwise(S.fixed(F.col("value"), 2))
    line = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "type", F.lit("\n"), "name", F.lit(" "), value)
    return metrics.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "value", "type")))).alias("json"))


#: Names, kinds and help texts of the exported series.
SERIES = {
    "files_scanned_total": ("counter", "Total media files discovered"),
    "jobs_submitted_total": ("counter", "Total transcoding jobs submitted"),
    "jobs_completed_total": ("counter", "Total transcoding jobs completed successfully"),
    "jobs_failed_total": ("counter", "Total transcoding jobs failed permanently"),
    "quality_failed_total": ("counter", "Total jobs that failed VMAF quality verification"),
    "deduplicated_files_total": ("counter", "Total files skipped or flagged by deduplication"),
    "notifications_sent_total": ("counter", "Total notifications delivered"),
    "queue_pending_depth": ("gauge", "Current pending entries in queue"),
    "queue_leased_depth": ("gauge", "Current leased entries in worker prefetch"),
    "active_cpu_workers": ("gauge", "Current active CPU workers"),
    "active_gpu_sessions": ("gauge", "Current active GPU hardware encoding sessions"),
    "write_actor_queue_size": ("gauge", "Pending write mutations in persistence channel"),
    "vmaf_score_average": ("gauge", "Average VMAF score of transcoded media"),
}


def series(queue: DataFrame, audit: DataFrame, files: DataFrame, delivered: DataFrame, prefix: str = "") -> DataFrame:
    """(name, type, help, value) of all series, from the tables' own rows: jobs by state, events by type,
    files (with ``is_duplicate``) and delivery records. No write waits in a batch engine, so that gauge is 0.
    Each table is read once, for one row of sums."""
    count = lambda holds: F.count(F.when(holds, 1))
    state, event, vmaf = F.col("state"), F.col("event_type"), F.col("vmaf")
    jobs = queue.agg(F.count("*").alias("jobs_submitted_total"), count(state == "pending").alias("queue_pending_depth"), count(state == "leased").alias("queue_leased_depth"), count(state.isin("evaluating", "processing")).alias("active_cpu_workers"), count(state == "transcoding").alias("active_gpu_sessions"))
    events = audit.agg(count(event == "job_completed").alias("jobs_completed_total"), count(event == "job_failed").alias("jobs_failed_total"), count(event == "job_quality_failed").alias("quality_failed_total"), F.coalesce(F.avg(F.when((event == "job_completed") & (vmaf > 0), vmaf)), F.lit(0.0)).alias("vmaf_score_average"))
    found = files.agg(F.count("*").alias("files_scanned_total"), count(F.col("is_duplicate")).alias("deduplicated_files_total"))
    sent = delivered.agg(count(F.col("status") == DELIVERED).alias("notifications_sent_total"))
    one = jobs.crossJoin(events).crossJoin(found).crossJoin(sent).withColumn("write_actor_queue_size", F.lit(0))  # a row each
    rows = F.array(*[F.struct(F.lit(prefix + n).alias("name"), F.lit(k).alias("type"), F.lit(h).alias("help"), F.col(n).cast("double").alias("value")) for n, (k, h) in SERIES.items()])
    return one.select(F.inline(rows))


def constant_health() -> str:
    """What a server that answers at all says of itself."""
    return "healthy"


def chart_scale(savings: DataFrame) -> DataFrame:
    """(total, scale) of a savings chart: the sum, and the largest value but at least 1024."""
    return savings.agg(F.coalesce(F.sum("saved_bytes"), F.lit(0)).alias("total"), F.greatest(F.coalesce(F.max("saved_bytes"), F.lit(0)), F.lit(1024)).alias("scale"))


def worst_health(checks: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return checks.agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), worst + 1).alias("status"))


def add_schedule(rows: DataFrame, now: Column) -> DataFrame:
    """Schedule entries with defaults: priority 50 when not positive, a past or missing time is now + 1 s."""
    soon = now + F.make_dt_interval(secs=F.lit(1))
    return rows.withColumns({
        "priority": F.when(F.coalesce(F.col("priority"), F.lit(0)) <= 0, 50).otherwise(F.col("priority")),
        "scheduled": F.when(F.col("scheduled").isNull() | (F.col("scheduled") <= now), soon).otherwise(F.col("scheduled")),
        "executed": F.lit(False),
    })


#: The body of a request for a schedule entry.
SCHEDULE_BODY = "id string, file_paths array<string>, priority int, scheduled timestamp"


def read_schedule(bodies: DataFrame, now: Column, col: str = "body") -> DataFrame:
    """Schedule entries of JSON bodies; one that isn't JSON or has no paths is left out, one without an id
    gets a name from its content."""
    rows = bodies.select(F.from_json(F.col(col), SCHEDULE_BODY).alias("e"), F.xxhash64(F.col(col)).alias("_key")).select("e.*", "_key").filter(F.size("file_paths") > 0)
    named = rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("schedule-"), F.hex("_key")))).drop("_key")
    return add_schedule(named, now)


def list_schedule(schedule: DataFrame) -> DataFrame:
    return schedule.orderBy("scheduled", "id")


def remove_schedule(schedule: DataFrame, entry: str) -> DataFrame:
    return schedule.filter(F.col("id") != entry)


#: Fixed value: the priority of paths that a user triggers by hand.
MANUAL_PRIORITY = 75


def trigger_now(schedule: DataFrame, entry: str) -> DataFrame:
    """(id, priority, file_path) of one entry, whenever it is due; ready for ``queue.enqueue``."""
    one = schedule.filter(F.col("id") == entry)
    return one.select("id", F.lit(MANUAL_PRIORITY).alias("priority"), F.explode("file_paths").alias("file_path")).filter(F.col("file_path").startswith("/"))


def due_paths(schedule: DataFrame, now: Column) -> DataFrame:
    """(id, priority, file_path) of due entries; only absolute paths count."""
    due = schedule.filter((F.col("scheduled") <= now) & ~F.col("executed"))
    return due.select("id", "priority", F.explode("file_paths").alias("file_path")).filter(F.col("file_path").startswith("/"))


def mark_executed(schedule: DataFrame, now: Column) -> DataFrame:
    return schedule.withColumn("executed", F.col("executed") | (F.col("scheduled") <= now))


def window_triggers(ticks: DataFrame, windows: Sequence[tuple[str, int, int]], minute: Column) -> DataFrame:
    """(tick columns, window, edge) where the minute of the day is a window's start or end; windows that
    pass midnight get no special care. Windows are configuration, a literal array."""
    edges = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(e).alias("edge"), F.lit(m).alias("at")) for n, a, b in windows for e, m in (("start", a), ("end", b))])
    hit = F.filter(edges, lambda e: e["at"] == minute)
    return ticks.withColumn("_hit", F.explode(hit)).select(*ticks.columns, F.col("_hit.window").alias("window"), F.col("_hit.edge").alias("edge"))


def stuck(events: DataFrame, key: str, ts: str, limit_seconds: int, span_seconds: int = 86_400) -> DataFrame:
    """Adds ``silent`` (seconds to the key's next event, null for its last and for a null time) and ``is_stuck``.

    Events are ordered within spans of time of a key, so that no task orders all of a busy key's; the
    first time of each span, a row for each key and span, closes the one before it. Null keys are one key.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.withColumn("_span", F.floor(micros / (span_seconds * 1_000_000)))
    firsts = rows.groupBy(key, "_span").agg(F.min(ts).alias("_at"))
    ends = firsts.withColumn("_at", F.lead("_at").over(Window.partitionBy(key).orderBy("_span"))).withColumn("_end", F.lit(True))
    both = rows.withColumns({"_at": F.col(ts), "_end": F.lit(False)}).unionByName(ends, allowMissingColumns=True)
    after = F.lead("_at").over(Window.partitionBy(key, "_span").orderBy("_end", "_at", "event_id"))
    gap = F.floor((F.unix_micros(after.cast("timestamp")) - micros) / 1_000_000)
    found = both.withColumn("silent", gap.cast("long")).filter(~F.col("_end")).drop("_span", "_at", "_end")
    return found.withColumn("is_stuck", F.coalesce(F.col("silent") > limit_seconds, F.lit(False)))
