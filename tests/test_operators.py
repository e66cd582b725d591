"""Operators on tiny frames: the cases of the fixtures, and edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from framewright import catalog
from framewright.functions import scalar as S
from framewright.operators import audit, dedupe, evaluate, quality, queue, scan
from framewright.operators.evaluate import AudioPolicy, Rule
from framewright.schemas import QUEUE
from framewright.sources import config, files
from framewright.streaming import streams

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 1, 2)


def now():
    return F.lit(NOW).cast("timestamp")


def value(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())] if cols else [(0,)], list(cols) or ["_"])
    return row.select(expr.alias("v")).first()["v"]


PROBE = {
    "streams": [
        {"index": 0, "codec_name": "avc1", "codec_type": "video", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le", "color_transfer": "smpte2084"},
        {"index": 1, "codec_name": "truehd", "codec_type": "audio", "channels": 8, "channel_layout": "7.1", "tags": {"language": "eng"}, "disposition": {"default": 1}},
        {"index": 2, "codec_name": "subrip", "codec_type": "subtitle", "tags": {"language": "eng"}, "disposition": {"default": 1, "forced": 0}},
    ],
    "format": {"format_name": "matroska", "duration": "3600.5", "bit_rate": "12000000"},
}


def evaluated(spark, rules, policy=AudioPolicy(), probe=PROBE):
    df = spark.createDataFrame([("/a.mkv", json.dumps(probe))], "file_path string, json string")
    meta = evaluate.normalize(evaluate.read_probe_json(df), {"avc1": "h264"})
    return evaluate.stream_plan(evaluate.decide(meta, rules), policy).first()


def test_evaluate(spark):
    row = evaluated(spark, [Rule("r", 50, {"codec": "h264", "resolution": "1080p"}, "transcode", "balanced-hevc")])
    m = row["metadata"]
    assert (m["video_codec"], m["resolution"], m["is_hdr"], m["hdr"], m["has_surround"], m["has_lossless"]) == ("h264", "1080p", True, "hdr10", True, True)
    assert (row["decision"]["matched_rule"], row["decision"]["action"]) == ("r", "transcode")
    assert row["plan"]["map_args"] and "copy" in row["plan"]["audio_codec_args"]


@pytest.mark.parametrize(
    ("conditions", "matches"),
    [({"min_resolution": "1080p"}, True), ({"codec": " , "}, False), ({}, True), ({"IS_HDR": "true"}, True), ({"is_hdr": "yes"}, False), ({"min_bitrate": "12000000"}, True), ({"min_bitrate": "12000001"}, False)],
)
def test_conditions(spark, conditions, matches):
    assert (evaluated(spark, [Rule("r", 1, conditions, "copy")])["decision"]["matched_rule"] == "r") == matches


def test_audio_languages(spark):
    audio = [{"index": i, "codec_name": "aac", "codec_type": "audio", "channels": 2, "tags": t, "disposition": {"default": d}} for i, t, d in ((0, {"language": "eng"}, 1), (1, {"language": "fra"}, 0), (2, {}, 0))]
    row = evaluated(spark, [], AudioPolicy(["eng"]), {"streams": audio, "format": {}})
    assert [a for a in row["plan"]["map_args"] if a in ("0:0", "0:1", "0:2")] == ["0:0", "0:2"]


def test_empty_probe(spark):
    row = evaluated(spark, [], probe={})
    assert row["metadata"]["bitrate"] == 0 and row["plan"]["summary"].endswith("Audio: none")


def test_pixel_formats(spark):
    names = ["nv12", "yuv410p", "yuv444p", "yuv422p", "yuva444p16le"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    rows = df.select(S.bit_depth(F.col("f")).alias("d"), S.pix_fmt_review(F.col("f")).isNotNull().alias("r")).collect()
    assert [(r["d"], r["r"]) for r in rows] == [(12, True), (10, True), (8, True), (8, False), (8, True)]


def test_hlg_with_wide_primaries(spark):
    df = spark.createDataFrame([("arib-std-b67", "bt2020", None), ("arib-std-b67", None, None), (None, None, None)], "t string, p string, s array<map<string,string>>")
    assert [r[0] for r in df.select(S.hdr_kind(F.col("t"), F.col("p"), F.col("s"))).collect()] == ["hdr10", "hlg", "none"]


def test_numbers(spark):
    df = spark.createDataFrame([("N/A",), ("",), ("1.5",), (" 42 ",), ("99999999999999999999",)], "x string")
    assert [r[0] for r in df.select(S.parse_bitrate(F.col("x"))).collect()] == [0, 0, 0, 42, 2**63 - 1]


@pytest.mark.parametrize(("text", "minutes"), [("02:00", 120), ("23:59", 1439), ("00:00", 0), ("14:30", 870), ("02:00:00", 120), ("25:00", None), ("00:60", None), ("invalid", None), ("", None)])
def test_clock(spark, text, minutes):
    assert value(spark, S.clock_minutes(F.col("t")), t=text) == minutes


def test_progress_line(spark):
    p = value(spark, S.progress_fields(F.col("x")), x="frame=  120 fps=60.5 q=28.0 size= 1024kB time=00:00:04.50 bitrate=1863.7kbits/s speed=2.27x")
    assert (p["frames"], p["fps"], p["current_sec"], p["speed"]) == (120, 60.5, 4.5, 2.27)
    assert value(spark, S.progress_fields(F.col("x")), x="nothing here") is None
    assert value(spark, S.percentage(F.lit(4.5), F.lit(10.0))) == 45.0


def test_encoders(spark):
    has = F.create_map(*[F.lit(x) for n in ("hevc_nvenc", "h264_nvenc", "libx265", "libx264") for x in (n, True)])
    assert tuple(value(spark, evaluate.select_encoder(F.lit("hevc"), F.lit("nvenc"), has))) == ("hevc_nvenc", True)
    assert tuple(value(spark, evaluate.select_encoder(F.lit("hevc"), F.lit("cpu"), has))) == ("libx265", False)


def jobs(spark, n=200):
    rows = [(i, f"/media/video_w{i // 20}_f{i % 20}.mkv", "pending", None, 50, 0, T0, None, None, T0, None) for i in range(n)]
    return spark.createDataFrame(rows, QUEUE)


def test_queue_lifecycle(spark):
    q = queue.lease(jobs(spark), "w1", 15, now(), 60)
    b = queue.buckets(q).first()
    assert (b["pending"], b["leased"], b["total"]) == (185, 15, 200)
    q = queue.set_state(q, 0, "completed", "")
    q = queue.pause(q, 0)
    assert q.filter("id = 0").first()["state"] == "paused"
    q = queue.requeue(q, 0, now())
    q = queue.ignore(q, 0)
    row = queue.set_priority(q, F.col("id") == 0, 99).filter("id = 0").first()
    assert (row["state"], row["error_message"], row["priority"]) == ("skipped", "Manually excluded by user", 99)
    later = F.lit(NOW + dt.timedelta(hours=1)).cast("timestamp")
    assert q.filter(queue.expired(later)).count() == 14
    assert queue.recover_crashed(q, later).filter("retry_count = 1").count() == 14
    assert queue.reset_at_start(q).filter("retry_count > 0").count() == 0


def test_lease_order(spark):
    rows = [(i, f"/{i}", "pending", None, p, 0, T0, None, None, T0, None) for i, p in ((1, 50), (2, 100), (3, 10))]
    assert [r["id"] for r in queue.next_jobs(spark.createDataFrame(rows, QUEUE), now(), 3).collect()] == [2, 1, 3]


def test_all_states_in_buckets(spark):
    from framewright.schemas import STATES

    rows = [(i, f"/{i}", s, None, 50, 0, T0, None, None, T0, None) for i, s in enumerate(STATES)]
    assert tuple(queue.buckets(spark.createDataFrame(rows, QUEUE)).first()) == (1, 4, 3, 3, 11)


def test_search_after_limit(spark):
    assert queue.page(jobs(spark), "", 5, 0, "w0_f1.").count() == 0
    assert queue.clamp_page(0, -1) == (50, 0) and queue.clamp_page(900, 3) == (500, 3)


def test_enqueue(spark):
    q = jobs(spark, 3)
    paths = spark.createDataFrame([("/new",), ("/new",), ("/media/video_w0_f1.mkv",), (None,), ("/b",)], "file_path string")
    out = queue.enqueue(q, paths, now())
    assert out.count() == 5 and {r["id"] for r in out.collect()} == {0, 1, 2, 3, 4}


def test_dedupe_modes(spark):
    same = spark.createDataFrame([("X", 5, "h", 1), ("Y", 5, "h", 2), ("Z", 5, "h", 3), ("C", 9, None, 4)], "path string, size bigint, signature string, seq bigint")
    exact = {r["path"]: r["original"] for r in dedupe.mark_duplicates(same).collect()}
    live = {r["path"]: r["original"] for r in dedupe.mark_duplicates(same, "live").collect()}
    assert exact == {"X": None, "Y": "X", "Z": "X", "C": None}
    assert live == {"X": None, "Y": None, "Z": "Y", "C": None}


def test_scan_fates(spark):
    df = spark.createDataFrame([(p,) for p in ("/m/movie1.mkv", "/m/movie2.mp4", "/m/nested/clip.mov", "/m/movie2_crunched.mp4", "/m/movie.temp")], "path string")
    fates = [r["fate"] for r in scan.classify(df, ["*.temp"], ["mkv", "mp4", "mov"]).collect()]
    assert fates == ["accepted"] * 3 + ["processed", "excluded"]


def test_boundary_hashes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").write_bytes(b"x" * 100)
    (tmp_path / "c").write_bytes(b"x" * 99 + b"y")
    rows = {r["path"][-1]: (r["first_hash"], r["last_hash"]) for r in files.boundary_hashes(files.list_files(spark, [str(tmp_path)]), 10).collect()}
    assert rows["a"] == rows["b"] != rows["c"] and rows["a"][0] == rows["c"][0]


def test_quality(spark):
    assert value(spark, quality.verdict(F.lit(0.95), F.lit(None).cast("double"), 93.0))["passed"]
    assert value(spark, quality.verdict(F.lit(0.0), F.lit(None).cast("double"), 93.0))["passed"]
    assert not value(spark, quality.verdict(F.lit(0.5), F.lit(99.0), 93.0))["passed"]
    assert value(spark, quality.grew(F.lit(True), F.lit(100), F.lit(120)))


@pytest.mark.parametrize(("retries", "error", "state"), [(0, "exit", "pending"), (2, "exit", "pending"), (3, "exit", "permanently_failed"), (0, "got SIGSEGV", "permanently_failed")])
def test_outcomes(spark, retries, error, state):
    no, none = F.lit(False), F.lit(None).cast("string")
    out = quality.outcome(F.lit("/a.mkv"), F.lit("transcode"), no, none, no, no, F.lit(True), F.lit(error), no, F.lit(retries))
    assert value(spark, out)["state"] == state


def test_batch_and_messages(spark):
    events = spark.createDataFrame([(1, "job_completed", 104857600, 94.2), (2, "job_completed", 209715200, 96.1)], "seq_id bigint, event_type string, saved_bytes bigint, vmaf double")
    s = audit.batch_summary(audit.count_batches(events, 2), "batch").first()
    assert (s["n"], s["completed"], s["saved_bytes"]) == (2, 2, 314572800) and abs(s["avg_vmaf"] - 95.15) < 1e-9
    one = spark.createDataFrame([("job_failed", "a_b", "m", 0, 0.0, T0)], "event_type string, title string, message string, saved_bytes bigint, avg_vmaf double, timestamp timestamp")
    for kind in ("discord", "telegram", "slack", "gotify", "webhook", "smtp"):
        assert audit.render_message(kind, one, "s").first()["body"]
    assert json.loads(audit.render_message("gotify", one).first()["body"])["priority"] == 8


def test_metrics_text(spark):
    m = spark.createDataFrame([("files_scanned", "counter", "h", 42.0), ("vmaf", "gauge", "h", 95.5)], "name string, type string, help string, value double")
    text = audit.prometheus(m).first()["text"].splitlines()
    assert text[2].endswith(" 42") and text[5].endswith(" 95.50")


def test_config():
    text = {"database": {"busy_timeout": 3000}, "concurrency": {"worker_count": 8, "gpu_semaphore_limit": 2}, "filesystem": {"scan_interval": "1m30s"}, "notification": {"channels": [{"type": "slack", "token": "t"}]}}
    c = config.load(json.dumps(text), {"FRAMEWRIGHT_WORKERS": "16", "FRAMEWRIGHT_GPU_LIMIT": "-3", "FRAMEWRIGHT_HWACCEL": "VAAPI", "FRAMEWRIGHT_METRICS_PORT": "x"}, home="/srv/media/../lib")
    assert (c["concurrency"]["worker_count"], c["database"]["busy_timeout"], c["concurrency"]["gpu_semaphore_limit"]) == (16, 3000, 2)
    assert (c["filesystem"]["scan_interval"], c["transcoder"]["hardware_acceleration"], c["observability"]["metrics_port"]) == (90.0, "vaapi", 9090)
    assert c["database"]["path"] == "/srv/lib/library.db" and config.DEFAULTS["database"]["path"] == "library.db"
    assert config.load("", {"FRAMEWRIGHT_SCAN_INTERVAL": "0s"})["filesystem"]["scan_interval"] == 20
    c["observability"]["api_key"] = "k"
    hidden = config.redacted(c)
    assert hidden["observability"]["api_key"] == hidden["notification"]["channels"][0]["token"] == "***REDACTED***" and c["observability"]["api_key"] == "k"
    assert [r.name for r in config.rules(c)] == ["Skip Modern HEVC & AV1", "Transcode H.264 High Bitrate to HEVC"] and config.audio_policy(c).preferred_languages == ("eng", "ita", "und")
    with pytest.raises(ValueError):
        config.duration("5 minutes")


def test_rules_are_read_for_each_batch(spark):
    rules, got = [Rule("a", 1, {}, "copy")], []
    run = streams.with_fresh_rules(lambda: rules, lambda df, k: got.append(df.first()["decision"]["matched_rule"]))
    df = spark.createDataFrame([(1,)], "n int")
    run(df, 0)
    rules[:] = [Rule("b", 1, {}, "skip")]
    run(df, 1)
    assert got == ["a", "b"]


@pytest.mark.parametrize(
    ("codec", "prefer", "working", "want"),
    [
        ("h265", "auto", ["hevc_qsv", "hevc_vaapi"], ("hevc_qsv", True)), ("avc", "amf", ["h264_amf"], ("libx264", False)), ("av1", "amf", ["av1_amf"], ("libaom-av1", False)),
        ("av1", "vaapi", ["h264_vaapi"], ("h264_vaapi", True)), ("hevc", "", ["hevc_nvenc"], ("libx265", False)), ("av1", "cpu", ["libsvtav1", "av1_nvenc"], ("libsvtav1", False)),
        ("vp9", "auto", ["hevc_nvenc"], ("libx264", False)), ("HEVC", "NVENC", ["hevc_nvenc"], ("hevc_nvenc", True)), ("hevc", "none", ["hevc_nvenc"], ("libx265", False)),
    ],
)
def test_encoder_ladder(spark, codec, prefer, working, want):
    has = F.create_map(*[F.lit(x) for n in working for x in (n, True)])
    assert tuple(value(spark, evaluate.select_encoder(F.lit(codec), F.lit(prefer), has))) == want


def test_working_encoders(spark):
    got = value(spark, evaluate.working_encoders(F.array(*map(F.lit, ("libx264", "hevc_nvenc", "h264_qsv"))), F.array(F.lit("h264_qsv"))))
    assert got == {"libx264": True, "h264_qsv": True}


@pytest.mark.parametrize(("seconds", "duration", "eta"), [(None, "00:00", "--"), (-1, "00:00", "--"), (0, "00:00", "Done"), (59, "00:59", "~59s"), (60, "01:00", "~1m"), (61, "01:01", "~1m 1s"), (3599, "59:59", "~59m 59s"), (3661, "1:01:01", "~1h 1m")])
def test_times(spark, seconds, duration, eta):
    s = F.lit(seconds).cast("double")
    assert (value(spark, S.format_duration(s)), value(spark, S.format_eta(s))) == (duration, eta)


def test_texts_of_the_feed(spark):
    assert [value(spark, S.event_color(F.lit(x))) for x in ("job_failed", "job_skipped", "job_completed")] == [0xE74C3C, 0xF1C40F, 0x2ECC71]
    assert value(spark, S.first_error_line(F.lit("\n  first line \nerror: second"))) == "first line"
    assert value(spark, S.first_error_line(F.lit("x" * 71))) == "x" * 70 + "..." and value(spark, S.first_error_line(F.lit(""))) == "Transcode execution failed"
    assert [value(spark, S.event_title(F.lit(x))) for x in ("job_skipped_growth", "startup_recovery", "job_copied")] == ["Skipped", "Recovery", "job_copied"]
    assert value(spark, S.can_resume(F.lit("skipped"))) and not value(spark, S.can_resume(F.lit("review_required")))
    assert value(spark, S.hmac_sha256("key", F.lit("The quick brown fox jumps over the lazy dog"))) == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    assert value(spark, S.hmac_sha256("k" * 100, F.lit("é"))) == __import__("hmac").new(b"k" * 100, "é".encode(), "sha256").hexdigest()


def test_scores(spark):
    assert value(spark, quality.extract_score(F.lit("SSIM Y:0.98 U:0.97 All:0.981 (17)"), "ssim")) == 0.981
    assert value(spark, quality.extract_score(F.lit("no number 12"), "ssim")) is None and value(spark, quality.extract_score(F.lit("vmaf 93"), "vmaf")) is None
    assert value(spark, quality.extract_score(F.lit("a\nVMAF score: 95.5"), "vmaf")) == 95.5 == value(spark, quality.extract_score(F.lit("[vmaf] mean score: 95.5 x"), "vmaf"))


def test_events_are_appended_with_the_payload_of_their_outcome(spark):
    log = spark.createDataFrame([(7, NOW, "x", "info", "{}")], "seq_id bigint, timestamp timestamp, event_type string, severity string, payload_json string")
    fields = {"queue_id": F.lit(3), "vmaf": F.lit(93.456), "ssim": F.lit(0.98765), "preset": F.lit("p"), "error": F.lit("e"), "crash": F.lit(True)}
    new = spark.createDataFrame([("job_skipped_precheck",), ("job_crash",)], "event_type string").select("event_type", F.lit("").alias("severity"), audit.outcome_payload(F.col("event_type"), fields).alias("payload_json"))
    rows = {r["event_type"]: r for r in audit.append_events(log, new, now()).collect()}
    assert sorted(r["seq_id"] for r in rows.values()) == [7, 8, 9] and rows["job_crash"]["severity"] == "info"
    assert json.loads(rows["job_skipped_precheck"]["payload_json"]) == {"queue_id": 3, "vmaf": 93.46, "ssim": 0.9877, "preset": "p"}
    assert json.loads(rows["job_crash"]["payload_json"]) == {"queue_id": 3, "error": "e", "crash": True}


def test_batch_figures_and_message(spark):
    rows = [("b", "job_completed", 1024, 90.0), ("b", "job_failed", 999, 99.0), ("b", "job_quality_failed", 5, 50.0), ("b", "job_completed", None, 0.0)]
    s = audit.batch_summary(spark.createDataFrame(rows, "batch string, event_type string, saved_bytes bigint, vmaf double"), "batch")
    r = audit.summary_message(s).first()
    assert (r["n"], r["completed"], r["failed"], r["saved_bytes"], r["avg_vmaf"]) == (4, 2, 1, 1024, 90.0)
    assert (r["title"], r["message"], r["event_type"]) == ("Transcode Batch: 4 processed", "Batch finished: 2 completed, 1 failed. Saved: 1.00 KB", "batch_summary")
    body = audit.render_message("webhook", audit.summary_message(s).withColumn("timestamp", now())).first()["body"]
    assert json.loads(body)["total_items"] == 4 and json.loads(body)["average_vmaf"] == 90.0


def test_rate_limit(spark):
    rows = [(k, "c", T0 + dt.timedelta(seconds=k)) for k in range(70)]
    df = spark.createDataFrame(rows, "event_id bigint, channel string, timestamp timestamp")
    assert audit.within_rate(df, 3).count() == 6 and audit.within_rate(df, 0).count() == 70


def test_schedule_requests(spark):
    bodies = spark.createDataFrame([('{"id":"a","file_paths":["/x","y"],"priority":0}',), ("no json",), ('{"file_paths":["/z"],"priority":9,"scheduled":"2030-01-01T00:00:00Z"}',), ('{"file_paths":[]}',)], "body string")
    s = audit.read_schedule(bodies, now())
    rows = audit.list_schedule(s).collect()
    assert [r["priority"] for r in rows] == [50, 9] and rows[0]["scheduled"] == NOW + dt.timedelta(seconds=1) and rows[1]["id"].startswith("schedule-")
    assert [tuple(r) for r in audit.trigger_now(s, "a").collect()] == [("a", 75, "/x")] and audit.remove_schedule(s, "a").count() == 1


def test_stored_signatures(spark):
    import hashlib

    stored = spark.createDataFrame([("/a", 5, b"h1", b"h2", T0, T0)], "path string, size bigint, first_mb_hash binary, last_mb_hash binary, first_seen timestamp, last_scanned timestamp")
    found = spark.createDataFrame([("/a", 5, None, 1), ("/b", 5, "own", 2)], "path string, size bigint, signature string, seq int")
    got = {r["path"]: r["signature"] for r in dedupe.restore_signatures(found, stored).collect()}
    assert got == {"/a": hashlib.sha256(b"h1h2").hexdigest(), "/b": "own"}
    assert dedupe.signature_count(stored).first()[0] == 1 and dedupe.truncate_signatures(stored).count() == 0


def test_library_scan(spark, tmp_path):
    from framewright.plans import api

    deep = tmp_path / "lib" / "one" / "two"
    deep.mkdir(parents=True)
    for path, text in ((tmp_path / "lib" / "a.mkv", "same"), (deep.parent / "b.mkv", "same"), (deep / "c.mkv", "deep"), (tmp_path / "lib" / "d.txt", "t"), (tmp_path / "lib" / "e_crunched.mkv", "x")):
        path.write_text(text)
    (tmp_path / "lib" / "link.mkv").symlink_to(tmp_path / "lib" / "a.mkv")
    marked, report = api.scan_library(spark, [str(tmp_path / "lib"), str(tmp_path / "none"), str(tmp_path / "lib" / "d.txt")], (), ["mkv"], max_depth=1)
    assert sorted((r["path"].rsplit("/", 1)[1], r["is_duplicate"]) for r in marked.collect()) == [("a.mkv", False), ("b.mkv", True)]
    assert report.first().asDict() == {"seen": 4, "excluded": 1, "other_extension": 1, "accepted": 1, "duplicates": 1, "errors": 2}


def test_reports(spark):
    from framewright.plans import api

    log = spark.createDataFrame([(k, "job_completed" if k % 2 else "job_failed", 100 * k, 90.0) for k in range(30)], "seq_id bigint, event_type string, saved_bytes bigint, vmaf double")
    s = api.status(jobs(spark), log, spark.createDataFrame([(1,), (1,), (2,)], "size bigint")).first()
    assert (s["pending"], s["unique_files"], s["health"], len(s["recent_savings"]), len(s["recent_events"])) == (200, 2, "healthy", 8, 20)
    scopes = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, max_depth int")
    more = api.with_scope(scopes, spark.createDataFrame([("/b", 7)], "path string, max_depth int"))
    assert api.find_scope(more, "/b").first()["max_depth"] == 7 and api.without_scope(more, "/a").count() == 1
    chart = audit.chart_scale(log.filter("seq_id < 3")).first()
    assert (chart["total"], chart["scale"]) == (300, 1024)


def test_stuck_across_spans_and_null_keys(spark):
    hours = {"a": [0, 1, 23, 25, 100, 100, 171], None: [5, 40], "b": [7]}
    at = dt.datetime(2024, 3, 1)
    given = [(n, k, at + dt.timedelta(hours=h)) for n, (k, h) in enumerate((k, h) for k, hs in hours.items() for h in hs)]
    given.append((99, "a", None))
    found = audit.stuck(spark.createDataFrame(given, "event_id long, job string, ts timestamp"), "job", "ts", 86_400).collect()
    silent = {r["event_id"]: (r["silent"], r["is_stuck"]) for r in found}
    expected = {99: (None, False)}
    n = 0
    for hs in hours.values():
        for h, after in zip(hs, [*hs[1:], None], strict=True):
            gap = None if after is None else (after - h) * 3600
            expected[n] = (gap, gap is not None and gap > 86_400)
            n += 1
    assert silent == expected
    assert found[0].asDict().keys() == {"event_id", "job", "ts", "silent", "is_stuck"}


def test_duplicates_of_null_sizes_and_single_files(spark):
    rows = [("/a", 1, "x", 1), ("/b", 1, "x", 2), ("/c", 1, "x", 3), ("/d", None, "x", 4), ("/e", None, "x", 5), ("/f", 2, None, 6), ("/g", 2, None, 7), ("/h", 3, "x", 8)]
    files = spark.createDataFrame(rows, "path string, size long, signature string, seq long")
    none = dict.fromkeys(r[0] for r in rows)
    assert {r["path"]: r["original"] for r in dedupe.mark_duplicates(files).collect()} == none | {"/b": "/a", "/c": "/a"}
    assert {r["path"]: r["original"] for r in dedupe.mark_duplicates(files, "live").collect()} == none | {"/c": "/b"}


def test_sizes_past_64_bits(spark, tmp_path):
    rows = [(900_000, 120_000, 6_000, 5), (7, 3, 2, 5), (900_000, 120_000, 6_000, 2), (1, 5, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["l_orderkey"], r["l_linenumber"]): r["text"] for r in catalog.size_texts(spark, str(tmp_path)).collect()}
    assert got == {(900_000, 5): "589.35 EB", (7, 5): "42.00 MB", (900_000, 2): "686.65 MB", (1, 1): "5 B"}


def test_appended_events_are_numbered_in_order(spark):
    log = spark.createDataFrame([(7, dt.datetime(2024, 1, 1), "e", "info", "{}")], "seq_id bigint, timestamp timestamp, event_type string, severity string, payload_json string")
    new = spark.createDataFrame([(k, "e", "", str(k)) for k in (90_000, -5, 3, 40_000, 20_000)], "k bigint, event_type string, severity string, payload_json string")
    got = {r["seq_id"]: r["payload_json"] for r in audit.append_events(log, new, F.current_timestamp(), "k").collect()}
    assert got == {7: "{}", 8: "-5", 9: "3", 10: "20000", 11: "40000", 12: "90000"}
