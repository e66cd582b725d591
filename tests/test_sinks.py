"""The keyed sink, tree listings and rescans, deliveries, and the decision table of rules."""

import datetime as dt
import itertools
import json
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.operators import audit, evaluate
from framewright.sources import files, keyed
from framewright.sources.keyed import Conflict, KeyedTable, KeyedWriter
from framewright.streaming import streams

ROWS = "id bigint, path string, v int, first int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark, str(tmp_path / "t"), ROWS, "id", 16)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def load(spark, n=200):
    return spark.range(n).select("id", F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path"), F.lit(1).alias("v"), F.lit(7).alias("first"))


def test_an_upsert_touches_the_buckets_of_its_keys_only(spark, table):
    assert table.upsert(load(spark)) == 1
    before = table.version().files
    new = spark.createDataFrame([(5, "x", 2, 9), (5, "y", 3, 9), (900, None, 4, 9)], ROWS)
    assert table.upsert(new, ["first"], F.col("v")) == 2
    after = table.version().files
    changed = {b for b in {*before, *after} if before.get(b) != after.get(b)}
    mine = {str(r[0]) for r in new.select(F.pmod(F.xxhash64("id"), F.lit(16))).distinct().collect()}
    assert changed == mine and len(changed) <= 2
    assert rows(table.read().filter("id in (5, 900)")) == [(5, "y", 3, 7), (900, None, 4, 9)]
    assert table.read().count() == 201 and table.read(1).filter("id = 5").first()["path"] == "/p5"
    assert rows(table.lookup(spark.createDataFrame([(5,), (6,), (-1,)], "id bigint"))) == [(5, "y", 3, 7), (6, "/p6", 1, 7)]


def test_upsert_equals_a_model_over_random_changes(spark, table):
    rng, model = random.Random(3), {}
    for k in range(4):
        new = [(rng.randrange(40), rng.choice(["a", None, "b"]), k * 100 + i, rng.randrange(9)) for i in range(30)]
        table.upsert(spark.createDataFrame(new, ROWS), ["first"], F.col("v"))
        for i, p, v, first in new:
            model[i] = (i, p, v, model[i][3] if i in model else first)
        gone = rng.sample(range(40), 5)
        table.delete(spark.createDataFrame([(g,) for g in gone], "id bigint"))
        for g in gone:
            model.pop(g, None)
    assert rows(table.read()) == sorted(model.values())


def test_a_failed_write_leaves_the_last_version_as_it_was(spark, table):
    table.upsert(load(spark, 20))
    bad = load(spark, 20).withColumn("v", F.when(F.col("id") == 11, F.raise_error(F.lit("lost"))).otherwise(2).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    with pytest.raises(Exception, match="null id"):
        table.upsert(spark.createDataFrame([(None, "x", 1, 1)], ROWS))
    assert table.version().number == 1 and {r["v"] for r in table.read().collect()} == {1}
    assert len(os.listdir(os.path.join(table.path, "data"))) == len([f for fs in table.version().files.values() for f in fs])


def test_a_task_that_fails_removes_what_it_staged(table):
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "_bucket": pa.array([0, 1], pa.int32())})

    def broken():
        yield batch
        raise OSError("disk")

    writer = KeyedWriter({"path": table.path, "base": "0", "mode": "append"})
    with pytest.raises(OSError, match="disk"):
        writer.write(broken())
    assert os.listdir(os.path.join(table.path, "data")) == []
    staged = writer.write(iter([batch]))
    assert [(b, n) for b, _, n in staged.files] == [(0, 1), (1, 1)]
    writer.abort([staged, None])
    assert os.listdir(os.path.join(table.path, "data")) == [] and table.version().number == 0


def test_a_commit_from_an_old_version_is_a_conflict(spark, table):
    table.upsert(load(spark, 10))
    late = KeyedWriter({"path": table.path, "base": "0", "mode": "append"})
    staged = late.write(iter([pa.RecordBatch.from_pydict({"id": [1], "_bucket": pa.array([0], pa.int32())})]))
    with pytest.raises(Conflict):
        late.commit([staged])
    assert table.version().number == 1 and table.read().count() == 10
    with pytest.raises(Conflict):
        KeyedTable.create(spark, table.path, ROWS, "id")


def test_new_rows_are_numbered_on_and_no_bucket_is_rewritten(spark, tmp_path):
    queue = KeyedTable.create(spark, str(tmp_path / "q"), "id bigint, file_path string, priority int", "file_path", 8)
    queue.upsert(spark.createDataFrame([(41, "/a", 1)], "id bigint, file_path string, priority int"))
    old = {f for fs in queue.version().files.values() for f in fs}
    new = spark.createDataFrame([("/a", 5), ("/b", 5), ("/c", 5), ("/b", 5), (None, 5)], "file_path string, priority int")
    assert queue.insert_new(new, "id", ("s", 0)) == 2
    assert old <= {f for fs in queue.version().files.values() for f in fs}
    got = {r["file_path"]: (r["id"], r["priority"]) for r in queue.read().collect()}
    assert got["/a"] == (41, 1) and sorted(got) == ["/a", "/b", "/c"] and sorted(i for i, _ in got.values()) == [41, 42, 43]
    assert queue.insert_new(new, "id", ("s", 0)) == 2  # the batch is in
    assert queue.insert_new(new, "id", ("s", 1)) == 2 and queue.read().count() == 3  # nothing is new


def test_appends_are_numbered_without_a_gap(spark, tmp_path):
    log = KeyedTable.create(spark, str(tmp_path / "log"), "seq_id bigint, event_type string", "seq_id", 4)
    events = spark.range(100).repartition(7).select(F.lit("e").alias("event_type"))
    log.append(events, "seq_id", ("log", 0))
    log.append(events, "seq_id", ("log", 0))
    log.append(events.limit(3), "seq_id")
    assert sorted(r["seq_id"] for r in log.read().collect()) == list(range(1, 104))
    assert log.append(events.limit(0), "seq_id") == 2


def test_vacuum_keeps_what_the_last_versions_name(spark, table):
    for k in range(3):
        table.upsert(load(spark, 30).withColumn("v", F.lit(k)))
    assert table.vacuum(1) > 0
    assert table.read().count() == 30 and not os.path.exists(os.path.join(table.path, "_staged"))
    with pytest.raises(FileNotFoundError):
        table.read(0)


def test_an_empty_table_and_empty_changes(spark, table):
    none = spark.createDataFrame([], ROWS)
    assert table.read().count() == 0 and table.upsert(none) == 0 and table.delete(none.select("id")) == 0 and table.insert_new(none) == 0
    with pytest.raises(ValueError):
        KeyedTable.create(spark, table.path + "x", ROWS, "nothing")
    assert keyed._numbers(table.fs, table.root) == [0]


# Trees


def tree(root, *paths):
    for p in paths:
        full = root / p
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text("x" * len(p))


def listed(spark, root, n):
    spark.dataSource.register(files.TreeSource)
    return spark.read.format("file_tree").option("scopes", str(root)).option("partitions", n).load()


@pytest.mark.parametrize("n", [1, 3, 16, 256])
def test_a_tree_is_listed_whole_however_it_is_split(spark, tmp_path, n):
    tree(tmp_path, "top.mkv", *[f"one/deep/chain/{a}/{b}/f{c}.mkv" for a, b, c in itertools.product("abcd", "xy", range(2))], "one/deep/mid.mkv")
    (tmp_path / "one" / "link.mkv").symlink_to(tmp_path / "top.mkv")
    (tmp_path / "empty").mkdir()
    got = listed(spark, tmp_path, n)
    want = sorted(str(p) for p in tmp_path.rglob("*.mkv") if not p.is_symlink())
    assert sorted(r["path"] for r in got.collect()) == want
    parts = files._Tree({"scopes": str(tmp_path), "partitions": str(n)}).split()
    assert len(parts) <= n and (n < 16 or len(parts) >= 8)  # all of it lies below one folder


def test_rescans_give_what_is_new_or_changed(spark, tmp_path):
    root = tmp_path / "media"
    tree(root, "a/1.mkv", "b/2.mkv")
    q = streams.rescan(spark, [str(root)]).writeStream.format("memory").queryName("rescans").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def wait(n):
        end = time.time() + 60
        while time.time() < end and spark.table("rescans").count() < n:
            assert q.exception() is None
            time.sleep(0.2)

    wait(2)
    tree(root, "c/3.mkv")
    (root / "a" / "1.mkv").write_text("longer than before")
    wait(4)
    time.sleep(3)  # more ticks over an unchanged tree
    q.stop()
    got = sorted((os.path.basename(r["path"]), r["change"]) for r in spark.table("rescans").collect())
    assert got == [("1.mkv", "changed"), ("1.mkv", "new"), ("2.mkv", "new"), ("3.mkv", "new")]
    assert (streams.rescan_period(0), streams.rescan_period(1.5)) == ("20000 milliseconds", "1500 milliseconds")


# Deliveries

BATCHES = "channel string, n bigint, completed bigint, failed bigint, saved_bytes bigint, vmaf_sum double, vmaf_n bigint, closed_by string"


def test_a_batch_is_rendered_sent_and_recorded_for_each_channel(spark, tmp_path):
    sent = {}

    def send(channel, messages):
        if channel.name == "down":
            raise ConnectionError("refused")
        sent[channel.name] = [(r["body"], r["signature"]) for r in messages.collect()]

    channels = [audit.Channel("team", "slack"), audit.Channel("down", "gotify"), audit.Channel("quiet", "gotify", ("job_failed",)), audit.Channel("hook", "webhook", ("batch_summary",), "s")]
    run = streams.notify(channels, send, str(tmp_path / "records"), str(tmp_path / "dead"))
    batch = spark.createDataFrame([("all", 3, 2, 1, 2048, 180.0, 2, "size")], BATCHES)
    run(batch, 4)
    run(batch, 4)  # again, after a crash
    text = "Batch finished: 2 completed, 1 failed. Saved: 2.00 KB"
    assert json.loads(sent["team"][0][0]) == {"text": f"*Transcode Batch: 3 processed*\n{text}"} and set(sent) == {"team", "hook"}
    hook = json.loads(sent["hook"][0][0])
    assert hook["event_id"].startswith("batch-4-") and (hook["total_items"], hook["saved_bytes"], hook["average_vmaf"]) == (3, 2048, 90.0) and sent["hook"][0][1]
    records = spark.read.parquet(str(tmp_path / "records")).collect()
    assert sorted((r["channel"], r["status"], r["response"]) for r in records) == [("down", "failed", "refused"), ("hook", "delivered", "OK"), ("team", "delivered", "OK")]
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert len(dead) == 1 and (dead[0]["last_error"], dead[0]["retry_count"]) == ("refused", 0) and json.loads(dead[0]["event_json"])["message"] == text


def test_other_errors_stop_the_stream_and_no_taker_writes_nothing(spark, tmp_path):
    def send(channel, messages):
        raise KeyError("bug")

    batch = spark.createDataFrame([("all", 1, 1, 0, 0, 0.0, 0, "tick")], BATCHES)
    with pytest.raises(KeyError):
        streams.notify([audit.Channel("a", "slack")], send, str(tmp_path / "r"), str(tmp_path / "d"))(batch, 0)
    streams.notify([audit.Channel("a", "slack", ("job_failed",))], send, str(tmp_path / "r"), str(tmp_path / "d"))(batch, 0)
    assert not os.path.exists(tmp_path / "r")


def test_progress_events_are_lines_with_figures(spark):
    text = "header\nframe= 10 fps=25 time=00:00:20.00 bitrate=9k speed=2x\rframe= 20 fps=25 time=00:00:40.00 bitrate=8k speed=2x"
    got = streams.progress_events(spark.createDataFrame([(1, 5, text, 100)], "job_id bigint, seq bigint, value string, total_sec int")).collect()
    assert [(r["job_id"], r["kind"], r["frames"], r["current_sec"], r["total_sec"]) for r in got] == [(1, "update", 10, 20.0, 100.0), (1, "update", 20, 40.0, 100.0)]


def test_windows_of_event_time(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(t, "job_completed", 5), (t + dt.timedelta(seconds=20), "x", None), (t + dt.timedelta(seconds=70), "job_completed", 1)], "ts timestamp, event_type string, saved_bytes bigint")
    got = sorted((r["n"], r["completed"], r["saved_bytes"]) for r in streams.batches_by_time(events, 60).collect())
    assert got == [(1, 1, 1), (2, 1, 5)]


# Rules

RULE = "name string, priority int, ord int, codecs array<string>, resolutions array<string>, is_hdr boolean, has_surround boolean, min_bitrate bigint"
MEDIA = "id int, metadata struct<video_codec: string, resolution: string, is_hdr: boolean, has_surround: boolean, bitrate: bigint>"


def brute(rule_rows, media):
    for r in sorted(rule_rows, key=lambda r: (-r[1], r[2])):
        codec, size, hdr, surround, bitrate = media
        if all((r[3] is None or codec in r[3], r[4] is None or size in r[4], r[5] is None or hdr == r[5], r[6] is None or surround == r[6], r[7] is None or (bitrate is not None and bitrate >= r[7]))):
            return r[0]
    return "default"


def test_rules_of_a_table_equal_trying_them_one_by_one(spark):
    rng = random.Random(5)
    some = lambda xs: rng.choice([None, rng.sample(xs, rng.randrange(0, 3))])
    made = [(f"r{k}", rng.randrange(90), k, some(["h264", "hevc", "av1"]), some(["4k", "sd"]), rng.choice([None, None, True, False]), rng.choice([None, None, True, False]), rng.choice([None, rng.randrange(100)])) for k in range(60) if k]
    made = [r for r in made if any(x is not None for x in r[3:])]
    media = [(rng.choice(["h264", "hevc", "vp9", None]), rng.choice(["4k", "720p", None]), rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([None, rng.randrange(120)])) for _ in range(300)]
    for n in (0, 1, 3, 20, len(made)):
        df = evaluate.decide_by_table(spark.createDataFrame(list(enumerate(media)), MEDIA), spark.createDataFrame(made[:n], RULE))
        assert {r["id"]: r["matched_rule"] for r in df.collect()} == {k: brute(made[:n], m) for k, m in enumerate(media)}


def test_ten_thousand_rules_need_no_shuffle_of_rows(spark):
    made = [(f"r{k}", k % 100, k, [f"c{k % 50}", f"c{k % 49}"], ["4k"] if k % 3 else None, None, None, k * 37 % 5000) for k in range(10_000)]
    media = [(f"c{k % 60}", "4k" if k % 2 else "sd", True, False, k * 13 % 6000) for k in range(400)]
    frame = spark.createDataFrame(list(enumerate(media)), MEDIA)
    df = evaluate.decide_by_table(frame, spark.createDataFrame(made, RULE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan
    assert {r["id"]: r["matched_rule"] for r in df.collect()} == {k: brute(made, m) for k, m in enumerate(media)}
    with pytest.raises(ValueError, match="10,000"):
        evaluate.decide_by_table(frame, spark.createDataFrame([*made, made[0]], RULE))


def test_figures_round_as_printf_does(spark):
    from framewright.functions import scalar as S

    values = [1.005, 0.125, 2.675, 1.115, 0.375, 1e15 / 7, -0.125, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(S.fixed(F.col("v"), 2)).collect()
    assert [r[0] for r in got] == ["%.2f" % v for v in values]


def test_a_bucket_is_written_in_large_groups_and_buckets_follow_rows(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), ROWS, "id", 1)
    assert table.upsert(load(spark, 50_000)) == 1
    assert table.upsert(load(spark, 10).withColumn("v", F.lit(2))) == 2
    (file,) = table.version().files["0"]
    assert pq.ParquetFile(f"{table.path}/{file}").num_row_groups == 1
    assert table.read().groupBy("v").count().orderBy("v").collect() == [(1, 49_990), (2, 10)]
    assert [keyed.buckets_for(n) for n in (0, 9_000_000, 10**12)] == [16, 35, keyed.MOST_BUCKETS]


def test_of_new_rows_of_a_key_the_least_is_added(spark, table):
    new = spark.createDataFrame([(1, "b", 1, 1), (1, "a", 2, 2), (1, "b", 1, 1), (2, None, None, None)], ROWS)
    assert table.insert_new(new) == 1 and rows(table.read()) == [(1, "a", 2, 2), (2, None, None, None)]
