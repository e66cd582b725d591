"""Streams with state and timers, each run as a stream and held against a model or its batch form."""

import datetime as dt
import itertools
import json
import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framewright.operators import audit, dedupe
from framewright.sources.keyed import KeyedTable
from framewright.streaming import stateful

numbers = itertools.count()


class Feed:
    """A stream of files that a test adds to; ``wait`` polls what the query has given so far."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        (folder / "in").mkdir()
        self.frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))

    def add(self, *rows):
        names = [f.split()[0] for f in self.schema.split(", ")]
        path = self.folder / f"{next(numbers)}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        made = time.time() - 10_000 + next(numbers)  # files are taken in order of their times
        os.utime(path, (made, made))
        path.rename(self.folder / "in" / path.name)

    def start(self, df, mode="append", each="200 milliseconds"):
        self.name = f"out{next(numbers)}"
        w = df.writeStream.outputMode(mode).option("checkpointLocation", str(self.folder / "cp"))
        self.query = w.format("memory").queryName(self.name).trigger(processingTime=each).start()
        return self

    def rows(self):
        return self.spark.table(self.name).collect()

    def wait(self, holds, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not holds(self.rows()):
            assert self.query.exception() is None
            time.sleep(0.2)
        return self.rows()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.query.stop()


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


EVENTS = "channel string, event_type string, saved_bytes bigint, vmaf double"


def test_full_batches_flush_at_once_and_a_trickle_at_the_tick(feed):
    f = feed(EVENTS)
    f.add(*[("c", "job_completed", 10, 90.0)] * 25, ("d", "job_failed", 5, 80.0))
    with f.start(stateful.batches(f.frame, 10, 4)):
        got = f.wait(lambda rows: sum(r["n"] for r in rows) >= 26)
        assert sorted((r["channel"], r["n"], r["closed_by"]) for r in got) == [("c", 5, "tick"), ("c", 10, "size"), ("c", 10, "size"), ("d", 1, "tick")]
        full = next(r for r in got if r["n"] == 10)
        assert (full["completed"], full["failed"], full["saved_bytes"], full["vmaf_sum"], full["vmaf_n"]) == (10, 0, 100, 900.0, 10)
        failed = next(r for r in got if r["channel"] == "d")
        assert (failed["completed"], failed["failed"], failed["saved_bytes"], failed["vmaf_n"]) == (0, 1, 0, 0)


def test_the_ticker_runs_on_while_events_trickle(feed):
    """An event every second keeps no batch open: each window of three seconds flushes what has come."""
    f = feed(EVENTS)
    with f.start(stateful.batches(f.frame, 1000, 3)):
        for _ in range(10):
            f.add(("c", "job_completed", 1, None))
            time.sleep(1)
        got = f.wait(lambda rows: sum(r["n"] for r in rows) >= 10)
    assert sum(r["n"] for r in got) == 10 and len(got) >= 3 and max(r["n"] for r in got) <= 6
    assert {r["closed_by"] for r in got} == {"tick"}


def test_ticks_are_multiples_of_the_window():
    assert [stateful.next_tick(t, 10) for t in (0, 9_999, 10_000, 10_001)] == [10_000, 10_000, 20_000, 20_000]


PROGRESS = "job_id bigint, seq bigint, kind string, phase string, detail string, frames bigint, fps double, speed double, current_sec double, total_sec double, bitrate string, segment int, segments int"


def update(job, seq, at, total=100.0, speed=2.0):
    return (job, seq, "update", None, None, 5, 25.0, speed, at, total, "9kbits/s", None, None)


def phase(job, seq, name):
    return (job, seq, "phase", name, "why", None, None, None, None, None, None, None, None)


def test_a_silent_job_is_stuck_once_and_an_update_ends_it(feed):
    f = feed(PROGRESS)
    f.add(phase(1, 0, "evaluating"), update(1, 1, 20.0), phase(2, 0, "evaluating"), (3, 0, "segment", *[None] * 8, 2, 3))
    with f.start(stateful.track(f.frame, stuck_ms=1500, quality_ms=600_000), "update"):
        got = f.wait(lambda rows: sum(r["is_stuck"] for r in rows) >= 2)
        time.sleep(4)  # many micro-batches later nothing is repeated
        assert [r["job_id"] for r in f.rows() if r["is_stuck"]].count(1) == 1
        first = next(r for r in got if r["job_id"] == 1 and not r["is_stuck"])
        assert (first["phase"], first["pct"], first["eta"], first["frames"], first["bitrate"]) == ("transcoding", 20.0, 40, 5, "9kbits/s")
        quality = next(r for r in got if r["job_id"] == 3)
        assert (quality["phase"], quality["detail"], round(quality["pct"], 3)) == ("verifying_vmaf", "VMAF analysis segment 2/3", 97.667)
        stuck = next(r for r in got if r["job_id"] == 1 and r["is_stuck"])
        assert stuck["pct"] == 20.0 and 1 <= stuck["stuck_sec"] <= 30
        f.add(update(1, 2, 99.95), (2, 1, "done", *[None] * 10))
        got = f.wait(lambda rows: sum(r["is_stuck"] for r in rows if r["job_id"] == 1) == 2)
        late = [r for r in got if r["job_id"] == 1]
        assert [r["is_stuck"] for r in late] == [False, True, False, True] and late[2]["eta"] == 0
        assert [r["removed"] for r in got if r["job_id"] == 2][-1] and not [r for r in got if r["job_id"] == 3 and r["is_stuck"]]


def test_remaining_time_is_rounded_while_any_is_left():
    from types import SimpleNamespace as N

    s = stateful.step(None, N(kind="update", frames=1, fps=1.0, speed=1.0, current_sec=9995.0, total_sec=10000.0, bitrate=None), 7)
    assert (s["pct"], s["eta"], s["started_ms"], s["last_ms"]) == (99.95, 5, 7, 7)
    s = stateful.step(s, N(kind="update", frames=1, fps=1.0, speed=0.0, current_sec=10000.0, total_sec=10000.0, bitrate=None), 9)
    assert (s["eta"], s["started_ms"], s["last_ms"]) == (0, 7, 9)
    assert stateful.step(s, N(kind="segment", segment=0, segments=0), 9)["pct"] == 100.0


FILES = "path string, size bigint, signature string, seq bigint"


def test_live_duplicates_in_ten_batches_equal_the_batch_form(spark, feed):
    rows = [(f"/f{k}", [7, 7, 7, 8, None][k % 5] if k % 11 else 100 + k, "abc"[k % 3] if k % 13 else None, k) for k in range(60)]
    f = feed(FILES)
    for k in range(10):
        f.add(*rows[k * 6 : k * 6 + 6])
    with f.start(stateful.live_duplicates(f.frame)):
        got = f.wait(lambda made: len(made) >= 60)
    want = dedupe.mark_duplicates(spark.createDataFrame(rows, FILES), "live").collect()
    key = lambda r: (r["path"], r["is_duplicate"], r["original"])
    assert sorted(map(key, got), key=repr) == sorted(map(key, want), key=repr)
    assert any(r["is_duplicate"] for r in got)


def test_live_duplicates_hash_shared_sizes_only_and_know_paths_and_stored_hashes(feed):
    f = feed(FILES + ", stored string")

    def hash_of(path, size):
        if size == 1:
            raise AssertionError("a file of a size of its own was read")
        return path[1]

    f.add(("/a1", 1, None, 0, None), ("/x1", 5, None, 1, "x"), ("/x2", 5, None, 2, None), ("/x1", 5, None, 3, None), ("/y", 5, None, 4, None))
    with f.start(stateful.live_duplicates(f.frame, hash_of)):
        got = f.wait(lambda made: len(made) >= 5)
    assert {(r["path"], r["seq"]): r["original"] for r in got} == {("/a1", 0): None, ("/x1", 1): None, ("/x2", 2): "/x1", ("/x1", 3): None, ("/y", 4): None}


def test_rescans_give_new_and_changed_files(feed):
    f = feed("path string, size bigint, modified double")
    f.add(("/a", 1, 1.0), ("/b", 2, 1.0))
    with f.start(stateful.new_or_changed(f.frame)):
        f.wait(lambda made: len(made) >= 2)
        f.add(("/a", 1, 1.0), ("/b", 3, 2.0), ("/c", 1, 1.0))
        got = f.wait(lambda made: len(made) >= 4)
    assert sorted((r["path"], r["size"], r["change"]) for r in got) == [("/a", 1, "new"), ("/b", 2, "new"), ("/b", 3, "changed"), ("/c", 1, "new")]


def test_a_full_buffer_drops_and_counts(feed):
    f = feed("buffer string, seq bigint, event string")
    f.add(*[("b", k, f"e{k}") for k in range(8)], ("c", 0, "x"))
    with f.start(stateful.bounded(f.frame, capacity=5, drain=2, seconds=2)):
        got = f.wait(lambda made: sum(r["event"] is not None for r in made) >= 6)
    assert [r["event"] for r in got if r["buffer"] == "b" and r["event"]] == [f"e{k}" for k in range(5)]
    assert max(r["dropped"] for r in got if r["buffer"] == "b") == 3 and max(r["dropped"] for r in got if r["buffer"] == "c") == 0


def test_rate_limit_passes_the_same_rows_as_the_batch_form(spark, feed):
    schema = "event_id bigint, channel string, timestamp timestamp"
    rows = [(k, "ab"[k % 2], dt.datetime(2024, 1, 1, 0, k // 20, k % 20)) for k in range(100)]
    f = feed(schema)
    for k in range(0, 100, 25):
        f.add(*[(i, c, t.isoformat()) for i, c, t in rows[k : k + 25]])
    want = audit.within_rate(spark.createDataFrame(rows, schema), 3).collect()
    with f.start(stateful.within_rate(f.frame, 3)):
        got = f.wait(lambda made: len(made) >= len(want))
    assert sorted(r["event_id"] for r in got) == sorted(r["event_id"] for r in want) and len(want) == 30


SCHEDULE = "id string, seq bigint, kind string, priority int, scheduled timestamp, file_paths array<string>"


def test_schedule_entries_are_due_once(feed):
    f = feed(SCHEDULE)
    far = "2099-01-01T00:00:00"
    f.add(("now", 0, "add", 0, None, ["/a", "b", "/c"]), ("far", 0, "add", 9, far, ["/d"]), ("gone", 0, "add", 9, None, ["/e"]), ("gone", 1, "cancel", None, None, None))
    with f.start(stateful.due_paths(f.frame)):
        f.wait(lambda made: len(made) >= 2)
        f.add(("far", 1, "trigger", None, None, None))
        f.wait(lambda made: len(made) >= 3)
        time.sleep(2)
        got = f.rows()
    assert sorted((r["id"], r["priority"], r["file_path"]) for r in got) == [("far", 75, "/d"), ("now", 50, "/a"), ("now", 50, "/c")]


def test_a_restart_between_due_and_enqueued_neither_loses_nor_repeats(spark, feed, tmp_path):
    """The first hand-over fails after it has changed the queue; the batch runs again from the same checkpoint."""
    table = KeyedTable.create(spark, str(tmp_path / "queue"), "id bigint, file_path string, state string, priority int, retry_count int, created_at timestamp, scheduled_at timestamp", "file_path", 4)
    f = feed(SCHEDULE)
    f.add(("s", 0, "add", 60, None, ["/a", "/b"]))
    enter, calls = stateful.enqueue_due(table), []

    def crashing(batch, number):
        enter(batch, number)
        calls.append(number)
        if table.read().count() == 2 and calls.count(number) == 1:
            raise RuntimeError("driver lost")

    def run():
        return stateful.due_paths(f.frame).writeStream.foreachBatch(crashing).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    q = run()
    with pytest.raises(Exception, match="driver lost"):
        q.awaitTermination(60)
    version, crashed = table.version().number, calls[-1]
    calls.append(crashed)
    q = run()
    end = time.time() + 60
    while time.time() < end and calls.count(crashed) < 3:
        time.sleep(0.2)
    q.stop()
    assert calls.count(crashed) >= 3 and table.version().number == version
    assert sorted((r["file_path"], r["priority"]) for r in table.read().collect()) == [("/a", 60), ("/b", 60)]
    assert sorted(r["id"] for r in table.read().collect()) == [1, 2]


def test_running_mean_over_batches(spark, feed):
    f = feed(EVENTS)
    f.add(("c", "x", 0, 90.0), ("c", "x", 0, 0.0), ("d", "x", 0, None))
    f.add(("c", "x", 0, 70.0))
    with f.start(stateful.running_mean(f.frame), "complete"):
        got = f.wait(lambda made: any(r["count"] == 2 for r in made))
    assert sorted((r["channel"], r["sum"], r["count"], r["mean"]) for r in got) == [("c", 160.0, 2, 80.0), ("d", 0.0, 0, 0.0)]


def test_state_survives_a_restart(feed, tmp_path):
    f, got = feed(FILES), []

    def until(n):
        q = stateful.live_duplicates(f.frame).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        end = time.time() + 60
        while time.time() < end and len(got) < n:
            time.sleep(0.2)
        q.stop()

    f.add(("/a", 9, "s", 0), ("/b", 9, "s", 1))
    until(2)
    f.add(("/c", 9, "s", 2))
    until(3)
    assert [(r["path"], r["original"]) for r in got] == [("/a", None), ("/b", None), ("/c", "/b")]


def test_no_limit_keeps_no_state(spark):
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), "x")], "event_id bigint, channel string, timestamp timestamp, more string")
    assert stateful.within_rate(rows, 0).columns == ["event_id", "channel", "timestamp"]
    assert stateful.running_mean(rows.select("channel", F.lit(1.0).alias("vmaf"))).first()["mean"] == 1.0


def test_a_new_size_asks_its_state_once():
    asked = []

    class Held(dict):
        def exists(self):
            asked.append("exists")
            return bool(self)

        def containsKey(self, k):
            asked.append(k)
            return k in self

        getValue, updateValue = dict.get, dict.__setitem__

    held = {}
    processor = stateful.LiveDuplicates(None)
    processor.init(type("Handle", (), {"getMapState": lambda self, name, *_: held.setdefault(name, Held())})())
    rows = lambda *some: [Row(path=p, seq=i, signature=s, stored=None) for i, (p, s) in enumerate(some)]
    run = lambda *some: [r["original"] for r in processor.handleInputRows((9,), iter(rows(*some)), None)]
    assert run(("/a", "s"), ("/b", "s"), ("/c", "s"), ("/b", "s"), ("/d", "t"), ("/a", "s"), ("/e", None)) == [None, None, "/b", None, None, None, None]
    assert asked == ["exists"]
    assert run(("/f", "t"), ("/b", "s"), ("/g", "u"), ("/h", "u"), ("/a", "s")) == ["/d", None, None, "/g", None]
