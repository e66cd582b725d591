"""Streams with state and timers: batches on a free ticker, live progress, live duplicates, rescans, bounded
buffers, rate limits, schedules.

Each is a ``StatefulProcessor`` for ``groupBy(key).transformWithState``: one small state for each key in the state
store, timers instead of polling. Timers of processing time fire in whatever micro-batch comes next, and Spark runs
one at every trigger, so give such a query a ``processingTime`` trigger (``availableNow`` would go on for ever).
What a stop leaves in a state is taken up by the next start. ``use_timers`` sets the state store that timers need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds of silence after which a job is stuck, and in the phase of quality verification.
STUCK_MS, STUCK_MS_QUALITY = 45_000, 120_000
#: Phases of a job that events of progress imply.
TRANSCODING, VERIFYING = "transcoding", "verifying_vmaf"
#: Size and window in seconds of a batch of notifications where none are configured.
BATCH_SIZE, BATCH_SECONDS = 10, 10
#: Priority of schedule entries without one, and of those run by hand; events that a buffer holds.
PRIORITY, MANUAL_PRIORITY, BUFFER = 50, 75, 500


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(df: DataFrame, key: str | list[str], processor: StatefulProcessor, schema: str, mode: str = "Append", time: str = "ProcessingTime") -> DataFrame:
    use_timers(df.sparkSession)
    return df.groupBy(*([key] if isinstance(key, str) else key)).transformWithState(processor, schema, mode, time)


def next_tick(now_ms: int, seconds: float) -> int:
    """The tick after now of a clock that ticks every ``seconds``, whatever happens between."""
    width = int(seconds * 1000)
    return (now_ms // width + 1) * width


# Batches by count or time

FIGURES = ("n", "completed", "failed", "saved_bytes", "vmaf_sum", "vmaf_n")
_FIGURES = "n bigint, completed bigint, failed bigint, saved_bytes bigint, vmaf_sum double, vmaf_n bigint"
NO_FIGURES = (0, 0, 0, 0, 0.0, 0)


def add_event(acc: tuple, row: Any) -> tuple:
    """Figures of a batch with one event more; bytes and scores count of completed jobs only, scores above 0."""
    done = row.event_type == "job_completed"
    vmaf = row.vmaf if done and row.vmaf is not None and row.vmaf > 0 else None
    return (
        acc[0] + 1, acc[1] + done, acc[2] + (row.event_type == "job_failed"), acc[3] + ((row.saved_bytes or 0) if done else 0),
        acc[4] + (vmaf or 0.0), acc[5] + (vmaf is not None),
    )


class BatchWindow(StatefulProcessor):
    def __init__(self, key: str, size: int, seconds: float):
        self.key, self.size, self.seconds = key, size, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", f"{_FIGURES}, tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *acc, tick = self.state.get() if self.state.exists() else (*NO_FIGURES, 0)
        for row in rows:
            acc = add_event(acc, row)
            if acc[0] >= self.size:
                yield self._out(key, acc, "size")
                acc = NO_FIGURES
        if acc[0] and not tick:
            tick = next_tick(timerValues.getCurrentProcessingTimeInMs(), self.seconds)
            self.handle.registerTimer(tick)
        self.state.update((*acc, tick))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        acc = self.state.get()[:-1] if self.state.exists() else NO_FIGURES
        self.state.clear()
        if acc[0]:
            yield self._out(key, acc, "tick")

    def _out(self, key: tuple, acc: tuple, why: str) -> Row:
        return Row(**{self.key: key[0]}, **dict(zip(FIGURES, acc, strict=True)), closed_by=why)


def batches(events: DataFrame, size: int = BATCH_SIZE, seconds: float = BATCH_SECONDS, key: str = "channel") -> DataFrame:
    """Figures of every ``size`` events of a key, and at each tick of a clock of ``seconds`` of what has come by then.

    The clock runs on whatever arrives: neither an event nor a full batch puts a tick off, so an event waits for one
    window at most, however slowly events trickle. A size or window that isn't positive is the default. Out: key, n, completed, failed,
    saved_bytes, vmaf_sum, vmaf_n, closed_by (size or tick). Events: key, event_type, saved_bytes, vmaf.
    """
    size, seconds = (size if size > 0 else BATCH_SIZE), (seconds if seconds > 0 else BATCH_SECONDS)
    return _run(events.select(key, "event_type", "saved_bytes", "vmaf"), key, BatchWindow(key, size, seconds), f"{key} string, {_FIGURES}, closed_by string")


# Live progress

PROGRESS = ("phase", "detail", "frames", "fps", "speed", "current_sec", "total_sec", "pct", "bitrate", "eta", "started_ms", "last_ms")
_PROGRESS = "phase string, detail string, frames bigint, fps double, speed double, current_sec double, total_sec double, pct double, bitrate string, eta bigint, started_ms bigint, last_ms bigint"


def step(state: dict | None, row: Any, now_ms: int) -> dict:
    """Progress of a job after an event: a phase that is set, an encoder's update, a segment of quality verification."""
    s = dict(state or dict.fromkeys(PROGRESS) | {"frames": 0, "fps": 0.0, "speed": 0.0, "current_sec": 0.0, "total_sec": 0.0, "pct": 0.0, "eta": 0, "started_ms": now_ms})
    s["last_ms"] = now_ms
    if row.kind == "phase":
        s["phase"], s["detail"] = row.phase, row.detail
    elif row.kind == "update":
        s |= {"phase": TRANSCODING, "frames": row.frames or 0, "fps": row.fps or 0.0, "speed": row.speed or 0.0, "current_sec": row.current_sec or 0.0, "total_sec": row.total_sec or 0.0, "bitrate": row.bitrate}
        s["pct"] = min(100.0, s["current_sec"] / s["total_sec"] * 100) if s["total_sec"] > 0 else 0.0
        if s["speed"] > 0 and s["total_sec"] > s["current_sec"]:
            s["eta"] = int((s["total_sec"] - s["current_sec"]) / s["speed"] + 0.5)
        elif s["pct"] >= 99.9:
            s["eta"] = 0
    elif row.kind == "segment":
        s["phase"], s["detail"] = VERIFYING, "VMAF quality verification in progress"
        if (row.segments or 0) > 0:
            s["detail"] = f"VMAF analysis segment {row.segment}/{row.segments}"
            s["pct"] = 95.0 + row.segment / row.segments * 4.0
    return s


class Progress(StatefulProcessor):
    def __init__(self, stuck_ms: int, quality_ms: int):
        self.stuck_ms, self.quality_ms = stuck_ms, quality_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", f"{_PROGRESS}, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        *kept, timer = self.state.get() if self.state.exists() else (None, 0)
        state = dict(zip(PROGRESS, kept, strict=True)) if self.state.exists() else None
        done = False
        for row in sorted(rows, key=lambda r: r.seq):
            done = row.kind == "done"
            state = None if done else step(state, row, now)
        if timer:
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
            if done:
                yield _progress(key, dict.fromkeys(PROGRESS) | {"last_ms": now}, removed=True)
            return
        timer = now + self._limit(state) + 1
        self.handle.registerTimer(timer)
        self.state.update((*state.values(), timer))
        yield _progress(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        *kept, timer = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() != timer:  # of a silence that an event of this batch ended
            return
        state = dict(zip(PROGRESS, kept, strict=True))
        self.state.update((*kept, 0))  # this silence is told
        yield _progress(key, state, silent_ms=timerValues.getCurrentProcessingTimeInMs() - state["last_ms"])

    def _limit(self, state: dict) -> int:
        return self.quality_ms if state["phase"] == VERIFYING else self.stuck_ms


def _progress(key: tuple, state: dict, silent_ms: int | None = None, removed: bool = False) -> Row:
    return Row(job_id=key[0], **state, is_stuck=silent_ms is not None, stuck_sec=(silent_ms or 0) // 1000, removed=removed)


def track(events: DataFrame, stuck_ms: int = STUCK_MS, quality_ms: int = STUCK_MS_QUALITY) -> DataFrame:
    """Latest progress of each job that an event came for; a job silent for longer than the limit comes out once
    more, ``is_stuck`` with whole seconds of silence, and not again until an event has ended that silence.

    Events: job_id, seq (order of one job's events), kind (phase, update, segment, done), phase, detail, frames, fps, speed, current_sec, total_sec,
    bitrate, segment, segments. Silence is of the clock, as events arrive. A job that is done comes out as removed and
    leaves no state; an event after that begins anew.
    """
    return _run(events, "job_id", Progress(stuck_ms, quality_ms), f"job_id bigint, {_PROGRESS}, is_stuck boolean, stuck_sec bigint, removed boolean", "Update")


# Live duplicates


class LiveDuplicates(StatefulProcessor):
    def __init__(self, hash_of: Callable[[str, int], str | None] | None):
        self.hash_of = hash_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "seen boolean")
        self.originals = handle.getMapState("originals", "signature string", "path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each question to the state is a message to the JVM: what this call put in it knows, and where the state was empty, that is all.
        empty = first = not self.paths.exists()
        paths, originals = set(), {}
        for row in sorted(rows, key=lambda r: r.seq):
            original = None
            if first:
                first = False
                self._add_path(row.path, paths)
                if row.stored is not None:
                    self._add_original(row.stored, row.path, originals)
            elif row.path not in paths and (empty or not self.paths.containsKey((row.path,))):
                signature = self.hash_of(row.path, key[0]) if self.hash_of else row.signature
                if signature is not None:
                    if signature in originals:
                        original = originals[signature]
                    elif not empty and self.originals.containsKey((signature,)):
                        original = originals[signature] = self.originals.getValue((signature,))[0]
                    else:
                        self._add_original(signature, row.path, originals)
                        self._add_path(row.path, paths)
            yield Row(path=row.path, size=key[0], seq=row.seq, is_duplicate=original is not None, original=original)

    def _add_path(self, path: str, paths: set) -> None:
        self.paths.updateValue((path,), (True,))
        paths.add(path)

    def _add_original(self, signature: str, path: str, originals: dict) -> None:
        self.originals.updateValue((signature,), (path,))
        originals[signature] = path


def live_duplicates(files: DataFrame, hash_of: Callable[[str, int], str | None] | None = None) -> DataFrame:
    """``dedupe.mark_duplicates(mode="live")`` as a stream: (path, size, seq, is_duplicate, original), a row for each file.

    The first file of a size is kept without its hash; from the second on ``hash_of(path, size)`` is asked for it
    (default: the row's ``signature``), so files of a size of their own are never read. One whose hash is null is no
    duplicate. A path that comes again isn't one either. ``stored`` (a column, or null) is a hash that an earlier
    run kept of a file: the first of a size is known by it at once. Null sizes are left alone, as unique. State is a row for each
    distinct content; a copy adds none.
    """
    have = files.columns
    rows = files.select("path", "size", "seq", *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("signature", "stored")])
    alone = rows.filter("size IS NULL").select("path", "size", "seq", F.lit(False).alias("is_duplicate"), F.lit(None).cast("string").alias("original"))
    found = _run(rows.filter("size IS NOT NULL"), "size", LiveDuplicates(hash_of), "path string, size bigint, seq bigint, is_duplicate boolean, original string", time="None")
    return found.unionByName(alone)


# Rescans


class NewOrChanged(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "size bigint, modified double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        row = max(rows, key=lambda r: r.modified)
        now = (row.size, row.modified)
        if now != known:
            self.state.update(now)
            yield Row(path=key[0], size=row.size, modified=row.modified, change="new" if known is None else "changed")


def new_or_changed(listing: DataFrame) -> DataFrame:
    """Files of a stream of listings (path, size, modified) that weren't there in the last one or differ from it."""
    return _run(listing.select("path", "size", "modified"), "path", NewOrChanged(), "path string, size bigint, modified double, change string", time="None")


# Bounded buffers


class BoundedBuffer(StatefulProcessor):
    def __init__(self, capacity: int, drain: int, seconds: float):
        self.capacity, self.drain, self.seconds = capacity, drain, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event string")
        self.state = handle.getValueState("counts", "depth bigint, dropped bigint, tick bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        depth, dropped, tick = self.state.get() if self.state.exists() else (0, 0, 0)
        kept, lost = [], 0
        for row in sorted(rows, key=lambda r: r.seq):
            if depth < self.capacity:
                kept.append((row.event,))
                depth += 1
            else:
                lost += 1
        if kept:
            self.held.appendList(kept)
        if depth and not tick:
            tick = next_tick(timerValues.getCurrentProcessingTimeInMs(), self.seconds)
            self.handle.registerTimer(tick)
        self.state.update((depth, dropped + lost, tick))
        if lost:
            yield Row(buffer=key[0], event=None, dropped=dropped + lost)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        depth, dropped, _ = self.state.get()
        held = [r[0] for r in self.held.get()]
        out, left = held[: self.drain], held[self.drain :]
        tick = 0
        if left:
            self.held.put([(e,) for e in left])
            tick = next_tick(timerValues.getCurrentProcessingTimeInMs(), self.seconds)
            self.handle.registerTimer(tick)
        else:
            self.held.clear()
        self.state.update((len(left), dropped, tick))
        for event in out:
            yield Row(buffer=key[0], event=event, dropped=dropped)


def bounded(events: DataFrame, capacity: int = BUFFER, drain: int = BUFFER, seconds: float = 1.0) -> DataFrame:
    """(buffer, event, dropped): events as a bounded buffer lets them through, ``drain`` of them at each tick of ``seconds``.

    Events: buffer, seq, event (text, such as JSON). One that arrives while ``capacity`` are waiting is dropped; a row without
    an event then gives the number dropped in all so far. What waits stays in the state, in order.
    """
    return _run(events.select("buffer", "seq", "event"), "buffer", BoundedBuffer(capacity, drain, seconds), "buffer string, event string, dropped bigint")


# Rate limits


class MinuteLimit(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sent", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.state.get()[0] if self.state.exists() else 0
        if not n:
            self.handle.registerTimer(int(key[1].timestamp() * 1000) + 60_000)
        for row in sorted(rows, key=lambda r: (r.timestamp, r.event_id)):
            if n < self.limit:
                yield Row(event_id=row.event_id, channel=key[0], timestamp=row.timestamp)
            n += 1
        self.state.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def within_rate(messages: DataFrame, per_minute: int, late: str = "10 minutes") -> DataFrame:
    """``audit.within_rate`` as a stream: the first ``per_minute`` messages (event_id, channel, timestamp) of each channel and minute,
    in order of arrival and within a micro-batch of time; all where it isn't positive.

    A counter for each channel and minute, so that a busy channel's minutes are counted apart. It leaves when the watermark has
    passed its minute, ``late`` after it; what comes later than that is dropped.
    """
    rows = messages.select("event_id", "channel", "timestamp")
    if per_minute <= 0:
        return rows
    timed = rows.withWatermark("timestamp", late).withColumn("minute", F.date_trunc("minute", "timestamp"))
    return _run(timed, ["channel", "minute"], MinuteLimit(per_minute), "event_id bigint, channel string, timestamp timestamp", time="EventTime")


# Schedules


class Scheduler(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", "priority int, scheduled_ms bigint, file_paths array<string>, executed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        entry = self.state.get() if self.state.exists() else None
        for row in sorted(rows, key=lambda r: r.seq):
            if row.kind == "add":
                self._cancel(entry)
                at = int(row.scheduled.timestamp() * 1000) if row.scheduled is not None else 0
                entry = ((row.priority if (row.priority or 0) > 0 else PRIORITY), at if at > now else now + 1000, list(row.file_paths or []), False)
                self.handle.registerTimer(entry[1])
            elif row.kind == "cancel":
                self._cancel(entry)
                entry = None
            elif row.kind == "trigger" and entry:
                yield from self._paths(key, entry, MANUAL_PRIORITY, now)
        if entry:
            self.state.update(entry)
        else:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self.state.get() if self.state.exists() else None
        if entry and not entry[3] and entry[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((*entry[:3], True))
            yield from self._paths(key, entry, entry[0], timerValues.getCurrentProcessingTimeInMs())

    def _cancel(self, entry: tuple | None) -> None:
        if entry and not entry[3]:
            self.handle.deleteTimer(entry[1])

    @staticmethod
    def _paths(key: tuple, entry: tuple, priority: int, now: int) -> Iterator[Row]:
        for path in entry[2]:
            if path and path.startswith("/"):
                yield Row(id=key[0], priority=priority, file_path=path, due_ms=now)


def due_paths(requests: DataFrame) -> DataFrame:
    """(id, priority, file_path, due_ms): absolute paths of schedule entries, each when its entry is due.

    Requests: id, seq, kind (add, cancel, trigger), priority, scheduled, file_paths. An entry added without a time, or with
    one that has passed, is due in a second; without a priority it has 50. An entry runs once and stays as executed until it is
    cancelled or added anew. ``trigger`` gives its paths at once, with the priority of what is run by hand.
    """
    return _run(requests, "id", Scheduler(), "id string, priority int, file_path string, due_ms bigint")


def enqueue_due(table, stream: str = "schedule") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: enters due paths into a queue kept as a ``sources.keyed.KeyedTable`` with key
    ``file_path``. The batch number is part of the table's version, so a batch that runs again after a crash between due and
    enqueued changes nothing, and none is lost: the stream's state is only committed after it."""

    def run(batch: DataFrame, number: int) -> None:
        at = F.timestamp_millis("due_ms")
        rows = batch.select("file_path", F.lit("pending").alias("state"), "priority", F.lit(0).alias("retry_count"), at.alias("created_at"), at.alias("scheduled_at"))
        table.insert_new(rows, "id", (stream, number))

    return run


# Running means


def running_mean(scores: DataFrame, key: str = "channel", value: str = "vmaf") -> DataFrame:
    """(key, sum, count, mean) of scores above 0 so far; sums and counts merge, so Spark keeps them as a stream's
    state and sums up within each task first. The same function serves a bounded frame."""
    good = F.when(F.col(value) > 0, F.col(value))
    sums = scores.groupBy(key).agg(F.coalesce(F.sum(good), F.lit(0.0)).alias("sum"), F.count(good).alias("count"))
    return sums.withColumn("mean", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0))
