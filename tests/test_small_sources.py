"""Readers and helpers that no query calls."""

import json

from framewright.operators import audit, dedupe, evaluate, queue, scan
from framewright.operators.evaluate import Rule
from framewright.plans import api
from framewright.sources import files

STREAM = {"index": 0, "codec_name": "h264", "codec_type": "video", "width": 1920, "height": 1080, "pix_fmt": "yuv420p"}
SOUND = {"index": 1, "codec_name": "aac", "codec_type": "audio", "channels": 2, "tags": {"language": "eng"}}


def test_probe_documents_from_files_to_plans(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"streams": [STREAM, SOUND], "format": {"filename": "/m/a.mkv", "bit_rate": "5000000"}, "more": 1}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"streams": [STREAM | {"codec_name": "hevc"}]}))
    docs = files.read_probe_files(spark, str(tmp_path))
    assert docs.columns == ["streams", "format", "chapters"] and docs.count() == 2
    probes = docs.selectExpr("struct(*) AS probe", "coalesce(format.filename, '/m/b.mkv') AS file_path")
    got = {r["file_path"]: r for r in api.evaluate_library(probes, [Rule("old", 9, {"codec": "h264"}, "transcode", "balanced")]).collect()}
    assert got["/m/a.mkv"]["decision"]["matched_rule"] == "old" and got["/m/b.mkv"]["decision"]["matched_rule"] == "default"
    assert got["/m/a.mkv"]["metadata"]["resolution"] == "1080p" and got["/m/a.mkv"]["plan"]["map_args"] == ["-map", "0:v:0", "-map", "0:1"]


def test_encoder_listings(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Encoders:\n ------\n V....D libx265   x265\n V....D hevc_nvenc  nv\n\n")
    assert sorted(r["encoder"] for r in files.encoder_names(spark, str(tmp_path / "list.txt")).collect()) == ["hevc_nvenc", "libx265"]
    assert [evaluate.acceleration_device(d) for d in (["/dev/dri/renderD128", "/dev/dri/card0"], ["/dev/dri/renderD128"], [])] == ["/dev/dri/card0", "/dev/dri/renderD128", "/dev/dri"]


def test_scopes_are_united_and_visited_where_they_are(spark, tmp_path):
    one, two = (spark.createDataFrame([(p, k) for p in paths], "path string, size int") for k, paths in enumerate((["/a", "/b"], ["/b", "/c"])))
    both = scan.union_scopes([one, two])
    assert sorted(r["path"] for r in both.collect()) == ["/a", "/b", "/c"]
    folder = str(tmp_path)

    def note(rows):
        for r in rows:
            with open(folder + r["path"], "w") as f:
                f.write("seen")

    dedupe.visit(both, note)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]


def test_mean_of_no_scores_is_null_and_figures_are_json(spark):
    from pyspark.sql import functions as F

    from framewright.operators import quality

    got = spark.createDataFrame([([0.0, 90.0, 80.0],), ([0.0],), ([],)], "s array<double>").select(quality.mean_score(F.col("s")).alias("m")).collect()
    assert [r["m"] for r in got] == [85.0, None, None]
    made = audit.metrics_json(spark.createDataFrame([("b", "gauge", "h", 1.5), ("a", "counter", "h", 2.0)], "name string, type string, help string, value double")).first()["json"]
    assert [m["name"] for m in json.loads(made)] == ["a", "b"] and json.loads(made)[1]["value"] == 1.5


def test_jobs_are_deleted_by_a_frame_and_starts_follow_spans(spark):
    q, m = spark.createDataFrame([(k,) for k in range(6)], "id bigint"), spark.createDataFrame([(k,) for k in range(6)], "queue_id bigint")
    left, kept = queue.delete(q, m, q.filter("id > 2"))
    assert sorted(r[0] for r in left.collect()) == sorted(r[0] for r in kept.collect()) == [0, 1, 2]
    sizes = spark.createDataFrame([(b, b % 5 + 1) for b in range(40) if b % 7], "_block bigint, _size bigint")
    total, want = 0, {}
    for b in range(40):
        if b % 7:
            want[b] = total
            total += b % 5 + 1
    assert {r["_block"]: r["_before"] for r in queue.starts_of(sizes, 8).collect()} == want
