"""Every query of the library by name, and its SQL over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar as S
from framewright.operators import audit, dedupe, evaluate, quality, queue, scan
from framewright.operators.evaluate import Rule
from framewright.plans import api, views
from framewright.plans.scratch import shared_folder
from framewright.schemas import AUDIT as AUDIT_COLUMNS
from framewright.schemas import JOB_METADATA, SIGNATURE
from framewright.schemas import QUEUE as QUEUE_COLUMNS
from framewright.sources.keyed import KeyedTable, buckets_for
from framewright.streaming import stateful, streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
def now():
    return F.lit(dt.datetime(1998, 1, 1)).cast("timestamp")


FILES = """(SELECT '/' || source || '/' || doc_id || '.' || lang AS path, n_chars AS size, doc_id AS seq, lang,
    sha256(unhex(sha256(b[1:1048576])) || unhex(sha256(CASE WHEN octet_length(b) <= 1048576 THEN b ELSE b[-1048576:] END))) AS signature FROM (SELECT *, encode(coalesce(text, '')) AS b FROM documents))"""
QUEUE = """(SELECT o_orderkey AS id, '/media/' || o_orderkey || '.mkv' AS file_path,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'leased' ELSE 'completed' END AS state,
    CASE WHEN o_orderstatus = 'P' THEN 'w0' END AS worker_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
    CAST(o_orderkey % 4 AS INT) AS retry_count, o_orderdate AS scheduled_at,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 MINUTE END AS lease_expires_at FROM orders)"""
AUDIT = """(SELECT event_id AS seq_id, ts, CASE event_type WHEN 'purchase' THEN 'job_completed' WHEN 'error' THEN 'job_failed'
    WHEN 'signup' THEN 'job_quality_failed' WHEN 'view' THEN 'job_skipped_growth' ELSE 'job_skipped' END AS event_type,
    user_id AS queue_id, value AS vmaf, CAST(floor(value * 1000) AS BIGINT) AS saved_bytes, props FROM events)"""
SIZES = """CASE WHEN w >= 3800 OR h >= 2100 THEN '4k' WHEN w >= 1900 OR h >= 1000 THEN '1080p'
    WHEN w >= 1200 OR h >= 700 THEN '720p' WHEN w >= 800 OR h >= 450 THEN '480p' ELSE 'sd' END"""
MEDIA = f"""(SELECT *, {SIZES} AS resolution FROM (SELECT p_partkey, p_brand, p_type, lower(regexp_extract(p_type, '(\\w+)$', 1)) AS video_codec,
    CAST(floor(p_size * 50 * 16 / 9) AS INT) AS w, p_size * 50 AS h, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS bitrate,
    p_size % 2 = 0 AS is_hdr, p_size % 3 = 0 AS has_surround FROM part))"""
NOW_SQL = "TIMESTAMP '1998-01-01'"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


RULES = [
    Rule("tall steel", 90, {"codec": "steel, copper", "resolution": "1080p,4k"}, "transcode", "balanced"),
    Rule("hdr", 70, {"is_hdr": "true", "min_bitrate": "1200000"}, "review"),
    Rule("surround", 50, {"has_surround": "1", "unknown_key": "x"}, "copy"),
    Rule("nothing", 95, {"codec": " , "}, "copy"),
]
DECIDE_SQL = """CASE WHEN video_codec IN ('steel', 'copper') AND resolution IN ('1080p', '4k') THEN 'tall steel'
    WHEN is_hdr AND bitrate >= 1200000 THEN 'hdr' WHEN has_surround THEN 'surround' ELSE 'default' END"""


@query(f"""WITH f AS {FILES}, d AS (SELECT *, min(seq) OVER (PARTITION BY size, signature) AS first FROM f)
    SELECT CASE WHEN lang IN ('en', 'de') AND size >= 3000 THEN 'transcode' WHEN size < 300 THEN 'skip' ELSE 'copy' END AS action,
    count(*) AS n, sum(size)::BIGINT AS bytes FROM d WHERE seq = first GROUP BY 1""")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    kept = dedupe.mark_duplicates(views.files(spark, d)).filter("not is_duplicate")
    rules = [Rule("long", 90, {"codec": "en,de", "min_bitrate": "3000"}, "transcode"), Rule("rest", 10, {"min_bitrate": "300"}, "copy")]
    get = {"video_codec": F.col("lang"), "bitrate": F.col("size")}.__getitem__
    decided = evaluate.decide(kept, rules, "skip", "", get)
    return decided.groupBy(F.col("decision.action").alias("action")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"SELECT state, count(*) AS n FROM {QUEUE} GROUP BY state")
def queue_counts(spark, d):
    return queue.counts(views.queue(spark, d))


@query(f"""SELECT *, pending + leased + completed + failed AS total FROM (SELECT count(*) FILTER (state = 'pending') AS pending,
    count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'completed') AS completed, 0::BIGINT AS failed FROM {QUEUE})""")
def queue_buckets(spark, d):
    return queue.buckets(views.queue(spark, d))


TOP = f"(SELECT id FROM {QUEUE} WHERE state = 'pending' AND scheduled_at <= {NOW_SQL} ORDER BY priority DESC, scheduled_at, id LIMIT 15)"


@query(f"SELECT q.id, priority, epoch(scheduled_at)::BIGINT AS at FROM {QUEUE} q JOIN {TOP} t ON q.id = t.id")
def lease_topk(spark, d):
    return queue.next_jobs(views.queue(spark, d), now(), 15).select("id", "priority", F.unix_timestamp("scheduled_at").alias("at"))


@query(f"""SELECT CASE WHEN id IN {TOP} THEN 'leased' ELSE state END AS state, CASE WHEN id IN {TOP} THEN 'w1' ELSE worker_id END AS worker_id,
    count(*) AS n FROM {QUEUE} GROUP BY 1, 2""")
def lease_apply(spark, d):
    return queue.lease(views.queue(spark, d), "w1", 15, now(), 1800).groupBy("state", "worker_id").agg(F.count("*").alias("n"))


@query(f"SELECT id, state FROM (SELECT * FROM {QUEUE} ORDER BY id DESC LIMIT 100) WHERE file_path LIKE '%7%'")
def queue_page(spark, d):
    return queue.page(views.queue(spark, d), "all", 100, 0, "7").select("id", "state")


@query(f"""SELECT id, 'pending' AS state, retry_count + 1 AS retry_count, (epoch({NOW_SQL}) + 15 * pow(2, retry_count))::BIGINT AS at
    FROM {QUEUE} WHERE state = 'leased'""")
def requeue_backoff(spark, d):
    q = views.queue(spark, d).withColumn("was", F.col("state"))
    out = queue.requeue_with_backoff(q, F.col("state") == "leased", now(), S.backoff_seconds(F.col("retry_count")), F.lit("again"))
    return out.filter("was = 'leased'").select("id", "state", "retry_count", F.unix_timestamp("scheduled_at").alias("at"))


EXPIRED = f"(state = 'leased' AND (lease_expires_at IS NULL OR lease_expires_at <= {NOW_SQL}))"


@query(f"SELECT CASE WHEN {EXPIRED} THEN 'pending' ELSE state END AS state, sum(retry_count + CASE WHEN {EXPIRED} THEN 1 ELSE 0 END)::BIGINT AS retries, count(*) AS n FROM {QUEUE} GROUP BY 1")
def crash_recovery(spark, d):
    return queue.recover_crashed(views.queue(spark, d), now()).groupBy("state").agg(F.sum("retry_count").alias("retries"), F.count("*").alias("n"))


@query(f"SELECT CASE WHEN state = 'leased' THEN 'pending' ELSE state END AS state, sum(retry_count)::BIGINT AS retries, count(*) AS n FROM {QUEUE} GROUP BY 1")
def startup_reset(spark, d):
    return queue.reset_at_start(views.queue(spark, d)).groupBy("state").agg(F.sum("retry_count").alias("retries"), F.count("*").alias("n"))


@query(f"SELECT CASE WHEN state = 'leased' AND retry_count = 1 THEN 'pending' ELSE state END AS state, CASE WHEN retry_count = 1 THEN 99 ELSE priority END AS priority, count(*) AS n FROM {QUEUE} GROUP BY 1, 2")
def set_priority(spark, d):
    return queue.set_priority(views.queue(spark, d), F.col("retry_count") == 1, 99).groupBy("state", "priority").agg(F.count("*").alias("n"))


@query(f"""SELECT id, CASE id WHEN 7 THEN 'paused' WHEN 5 THEN 'skipped' ELSE state END AS state, CASE id WHEN 7 THEN 'Paused by user' WHEN 5 THEN 'Manually excluded by user' END AS error_message,
    CASE WHEN id NOT IN (5, 7) THEN worker_id END AS worker_id FROM {QUEUE}""")
def pause_ignore(spark, d):
    return queue.ignore(queue.pause(views.queue(spark, d), 7), 5).select("id", "state", "error_message", "worker_id")


@query(f"""SELECT id, CASE id WHEN 6 THEN 'evaluating' WHEN 4 THEN 'pending' ELSE state END AS state, CASE WHEN id = 4 THEN 0 ELSE retry_count END AS retry_count,
    CASE WHEN id = 6 THEN 'started' END AS error_message, CASE WHEN id <> 4 THEN worker_id END AS worker_id FROM {QUEUE}""")
def state_requeue(spark, d):
    """One job's state set, another put back by hand; all others stay."""
    q = queue.set_state(views.queue(spark, d), 6, "evaluating", "started")
    return queue.requeue(q, 4, now()).select("id", "state", "retry_count", "error_message", "worker_id")


@query(f"""WITH q AS (SELECT * FROM {QUEUE} WHERE id NOT IN (1, 2, 3) AND id % 5 <> 0), m AS (SELECT c_custkey AS queue_id FROM customer WHERE c_custkey NOT IN (1, 2, 3) AND (c_custkey % 5 <> 0 OR c_custkey NOT IN (SELECT o_orderkey FROM orders)))
    SELECT 'queue' AS side, id FROM q UNION ALL SELECT 'metadata', queue_id FROM m""")
def delete_jobs(spark, d):
    """Three jobs by a list, a fifth of all by a frame; both take their metadata along."""
    q, m = views.queue(spark, d), views.table(spark, d, "customer").select(F.col("c_custkey").alias("queue_id"))
    left, kept = queue.delete(*queue.delete(q, m, [1, 2, 3]), q.filter("id % 5 = 0"))
    return left.select(F.lit("queue").alias("side"), "id").unionByName(kept.select(F.lit("metadata").alias("side"), F.col("queue_id").alias("id")))


@query("""SELECT p_partkey, k = 0 AS has_nvenc, false AS has_qsv, k = 1 AS has_amf, k = 2 AS has_vaapi, CASE k WHEN 0 THEN 'av1_vaapi,h264_nvenc,libx265' WHEN 1 THEN 'av1_vaapi,hevc_amf,libx265' WHEN 2 THEN 'av1_vaapi,hevc_vaapi,libx265' ELSE 'av1_vaapi,libx265' END AS encoders
    FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part)""")
def hardware_families(spark, d):
    """Machines that list all encoders, each with one that also works."""
    listed = F.array(*[F.lit(x) for x in ("libx265", "h264_nvenc", "hevc_qsv", "hevc_amf", "hevc_vaapi", "av1_vaapi", "libx265")])
    works = F.array(pick(("h264_nvenc", "hevc_amf", "hevc_vaapi", "none"), F.col("p_partkey") % 4))
    r = evaluate.hardware_report(evaluate.working_encoders(listed, works))
    return views.table(spark, d, "part").select("p_partkey", *[r[f"has_{f}"].alias(f"has_{f}") for f in evaluate.TRIED], F.array_join(r["encoders"], ",").alias("encoders"))


NEW_PATHS = "(SELECT DISTINCT '/media/' || l_orderkey * 2 || '.mkv' AS file_path FROM lineitem)"
#: A queue after paths were entered: known paths keep their ids, the numbers of the others follow the last one.
ENTERED_SQL = f"""WITH q AS {QUEUE}, n AS (SELECT file_path FROM {NEW_PATHS} WHERE file_path NOT IN (SELECT file_path FROM q))
    SELECT file_path, id AS known_id, state, priority, false AS added, 0::BIGINT AS numbers FROM q
    UNION ALL SELECT file_path, NULL, 'pending', 50, true, (SELECT count(*) FROM n) FROM n"""


def entered(before, after):
    """``numbers``: how many distinct ids right after the last old one the new entries have."""
    last = before.agg(F.max("id")).first()[0]
    new = F.col("id") > last
    numbers = after.filter(new).agg(F.when(F.max("id") == last + F.count_distinct("id"), F.count_distinct("id")).alias("numbers"))
    rows = after.select("file_path", F.when(~new, F.col("id")).alias("known_id"), "state", "priority", new.alias("added"))
    return rows.crossJoin(F.broadcast(numbers)).withColumn("numbers", F.when(F.col("added"), F.col("numbers")).otherwise(0))  # one row


def new_paths(spark, d):
    return views.table(spark, d, "lineitem").select(F.concat(F.lit("/media/"), (F.col("l_orderkey") * 2).cast("string"), F.lit(".mkv")).alias("file_path"))


@query(ENTERED_SQL)
def enqueue_new(spark, d):
    q = views.queue(spark, d)
    return entered(q, queue.enqueue(q, new_paths(spark, d), now()))


@query(ENTERED_SQL)
def sink_queue(spark, d):
    """The same through the keyed sink, twice: the second time enters nothing."""
    q = views.queue(spark, d)
    table = KeyedTable.create(spark, shared_folder(spark), QUEUE_COLUMNS, "file_path", buckets_for(q.count()))
    table.upsert(q)
    paths = new_paths(spark, d).select("file_path", F.lit("pending").alias("state"), F.lit(50).alias("priority"), F.lit(0).alias("retry_count"), now().alias("created_at"), now().alias("scheduled_at"))
    table.insert_new(paths, "id", ("scan", 0))
    table.insert_new(paths, "id", ("scan", 1))
    return entered(q, table.read())


@query("""WITH o AS (SELECT o_custkey AS queue_id, arg_max(o_orderpriority, o_orderkey) AS preset, max(o_orderkey) AS bitrate FROM orders GROUP BY 1),
         c AS (SELECT c_custkey AS queue_id, c_mktsegment AS preset, c_nationkey AS bitrate FROM customer WHERE c_custkey % 3 <> 0)
    SELECT queue_id, coalesce(o.preset, c.preset) AS preset, CASE WHEN o.queue_id IS NULL THEN c.bitrate ELSE o.bitrate END AS bitrate, CASE WHEN c.queue_id IS NULL THEN 1 ELSE 0 END AS created
    FROM o FULL JOIN c USING (queue_id) WHERE queue_id % 7 <> 0""")
def sink_metadata(spark, d):
    """Metadata kept in a keyed table: loaded, changed by all orders (the last one of a job counts), some jobs deleted. When
    a row was made stays as it was."""
    table = KeyedTable.create(spark, shared_folder(spark), JOB_METADATA, "queue_id", buckets_for(views.table(spark, d, "customer").count()))
    at = lambda k: F.timestamp_seconds(F.lit(k))
    c, o = views.table(spark, d, "customer"), views.table(spark, d, "orders")
    table.upsert(c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("queue_id"), F.col("c_mktsegment").alias("preset"), F.col("c_nationkey").alias("bitrate"), at(0).alias("created_at")))
    changes = o.select(F.col("o_custkey").alias("queue_id"), F.col("o_orderpriority").alias("preset"), F.col("o_orderkey").alias("bitrate"), at(1).alias("created_at"))
    table.upsert(changes, ["created_at"], F.col("bitrate"))
    table.delete(c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("queue_id")))
    return table.read().select("queue_id", "preset", "bitrate", F.unix_timestamp("created_at").cast("int").alias("created"))


@query("""SELECT event_type, severity, k, count(*) AS n, (SELECT count(*) FROM events) * 2 AS numbers FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'warning' END AS severity, event_id % 10 AS k FROM events UNION ALL
    SELECT 'again', 'info', event_id % 10 FROM events) GROUP BY ALL""")
def sink_audit(spark, d):
    """All events appended to a keyed table in two batches, numbered without a gap; the second batch comes twice and counts once."""
    table = KeyedTable.create(spark, shared_folder(spark), AUDIT_COLUMNS, "seq_id", buckets_for(views.table(spark, d, "events").count()))
    k = F.col("event_id")
    events = views.table(spark, d, "events").select("event_type", F.when(k % 2 == 0, "info").otherwise("warning").alias("severity"), audit.payload(k=k % 10).alias("payload_json"), now().alias("timestamp"))
    table.append(events, "seq_id", ("log", 0))
    again = events.withColumns({"event_type": F.lit("again"), "severity": F.lit("info")})
    table.append(again, "seq_id", ("log", 1))
    table.append(again, "seq_id", ("log", 1))
    rows = table.read()
    ends = rows.agg(F.when((F.min("seq_id") == 1) & (F.max("seq_id") == F.count_distinct("seq_id")), F.max("seq_id")).alias("numbers"))
    counted = audit.parse_payload(rows, "k bigint").groupBy("event_type", "severity", F.col("payload.k").alias("k")).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(ends))  # one row


@query("""SELECT '/f/' || c_custkey AS path, size, CASE WHEN size IS NULL THEN 0 ELSE 883612800 END::BIGINT AS first_seen, CASE WHEN size IS NULL THEN 0 ELSE 883612800 END::BIGINT AS last_scanned
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS size FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def sink_signatures(spark, d):
    """Signatures in a keyed table: a scan starts first_seen anew where it doesn't give it."""
    table = KeyedTable.create(spark, shared_folder(spark), SIGNATURE, "path", buckets_for(views.table(spark, d, "customer").count()))
    key, blob = lambda x: F.concat(F.lit("/f/"), x.cast("string")).alias("path"), F.encode(F.lit("h"), "UTF-8")
    zero = F.timestamp_seconds(F.lit(0))
    table.upsert(views.table(spark, d, "customer").select(key(F.col("c_custkey")), blob.alias("first_mb_hash"), blob.alias("last_mb_hash"), zero.alias("first_seen"), zero.alias("last_scanned")))
    scan = views.table(spark, d, "orders").select(key(F.col("o_custkey")), F.col("o_orderkey").alias("size"), blob.alias("first_mb_hash"), blob.alias("last_mb_hash"), now().alias("first_seen"), now().alias("last_scanned"))
    table.upsert(scan, order=F.col("size"))
    return table.read().select("path", "size", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_scanned").alias("last_scanned"))


@query("""SELECT c_custkey AS queue_id, CASE WHEN o IS NOT NULL THEN o ELSE c_mktsegment END AS preset, c_nationkey AS created FROM customer
    LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def upsert_metadata(spark, d):
    old = views.table(spark, d, "customer").select(F.col("c_custkey").alias("queue_id"), F.col("c_mktsegment").alias("preset"), F.col("c_nationkey").alias("created"))
    o = views.table(spark, d, "orders")
    new = o.select(F.col("o_custkey").alias("queue_id"), F.col("o_orderpriority").alias("preset"), F.lit(-1).alias("created"), "o_orderkey")
    known = new.join(old.select("queue_id"), "queue_id", "left_semi")
    last = known.groupBy("queue_id").agg(F.max_by("preset", "o_orderkey").alias("preset"), F.first("created").alias("created"))
    return queue.upsert(old, last, "queue_id", ["created"])


STATS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY seq_id DESC) AS r FROM
    (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 200) WHERE event_type IN ('job_completed', 'job_quality_failed', 'job_skipped_growth') AND queue_id > 0) WHERE r = 1)"""


@query(f"SELECT queue_id, seq_id, event_type, saved_bytes FROM {STATS}")
def latest_job_stats(spark, d):
    return audit.latest_job_stats(views.audit(spark, d)).select("queue_id", "seq_id", "event_type", "saved_bytes")


@query(f"""SELECT queue_id, max(seq_id) AS seq_id FROM {AUDIT} WHERE event_type IN ('job_completed', 'job_quality_failed', 'job_skipped_growth') AND queue_id > 0 GROUP BY 1""")
def latest_by_job(spark, d):
    return audit.latest_by_job(views.audit(spark, d)).select("queue_id", "seq_id")


@query(f"SELECT id, state, event_type, saved_bytes FROM (SELECT * FROM {QUEUE} ORDER BY id DESC LIMIT 100) q LEFT JOIN {STATS} s ON s.queue_id = q.id")
def queue_with_stats(spark, d):
    stats = audit.latest_job_stats(views.audit(spark, d)).select(F.col("queue_id").alias("id"), "event_type", "saved_bytes")
    return queue.page(views.queue(spark, d)).join(F.broadcast(stats), "id", "left").select("id", "state", "event_type", "saved_bytes")  # 200 rows at most


@query(f"SELECT round(coalesce(avg(vmaf) FILTER (vmaf > 0), 0), 6) AS avg_vmaf FROM (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 15) WHERE event_type = 'job_completed'")
def avg_vmaf(spark, d):
    return audit.average_vmaf(views.audit(spark, d)).select(F.round("avg_vmaf", 6).alias("avg_vmaf"))


@query(f"SELECT seq_id, saved_bytes FROM (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 15) WHERE event_type = 'job_completed' AND saved_bytes > 0")
def recent_savings(spark, d):
    return audit.recent_savings(views.audit(spark, d))


@query(f"SELECT path, seq > first AS is_duplicate FROM (SELECT *, min(seq) OVER (PARTITION BY size, signature) AS first FROM {FILES})")
def dedupe_exact(spark, d):
    return dedupe.mark_duplicates(views.files(spark, d)).select("path", "is_duplicate")


DEDUPE_LIVE_SQL = f"""WITH f AS (SELECT *, min(seq) OVER (PARTITION BY size) AS hidden FROM {FILES}),
    g AS (SELECT size, signature, min(seq) AS first FROM f WHERE seq > hidden GROUP BY 1, 2)
    SELECT path, coalesce(seq > hidden AND seq > first, false) AS is_duplicate FROM f LEFT JOIN g USING (size, signature)"""


@query(DEDUPE_LIVE_SQL)
def dedupe_live(spark, d):
    return dedupe.mark_duplicates(views.files(spark, d), "live").select("path", "is_duplicate")


def in_slices(df, column, n):
    """A table by ranges of a column, in order; nulls come first."""
    ends = df.stat.approxQuantile(column, [k / n for k in range(1, n)], 0.01)
    edges = [None, *sorted(set(ends)), None]
    above = lambda a: F.lit(True) if a is None else F.col(column) > a
    upto = lambda b: F.lit(True) if b is None else F.col(column) <= b
    return [df.filter(F.coalesce(above(a) & upto(b), F.lit(a is None))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@query(DEDUPE_LIVE_SQL)
def stream_dedupe_live(spark, d):
    """The live index as a stream, over all files in slices, with a restart after each."""
    folder = shared_folder(spark)
    views.files(spark, d).drop("lang").write.parquet(f"{folder}/files")  # texts are read and hashed once, not for each slice
    files = spark.read.parquet(f"{folder}/files")
    made = streams.replay(in_slices(files, "seq", 4), stateful.live_duplicates, folder)
    return made.select("path", "is_duplicate")


@query(f"SELECT count(DISTINCT size) AS unique_files FROM {FILES}")
def unique_sizes(spark, d):
    return dedupe.unique_sizes(views.files(spark, d))


FATE = "CASE WHEN path GLOB '*/1?.*' OR path GLOB '*/*[05].fr' THEN 'excluded' WHEN path LIKE '%.es' THEN 'extension' ELSE 'accepted' END"


@query(f"""WITH f AS (SELECT *, seq > min(seq) OVER (PARTITION BY size, signature) AS dup, {FATE} AS fate FROM {FILES})
    SELECT count(*) AS seen, count(*) FILTER (fate = 'excluded') AS excluded, count(*) FILTER (fate = 'extension') AS other_extension,
    count(*) FILTER (fate = 'accepted' AND NOT dup) AS accepted, count(*) FILTER (fate = 'accepted' AND dup) AS duplicates, 0::BIGINT AS errors FROM f""")
def scan_report(spark, d):
    marked = dedupe.mark_duplicates(views.files(spark, d))
    return scan.report(scan.classify(marked, ["1?.*", "*[05].fr"], ["en", ".DE", "fr"]))


@query(f"SELECT {FATE} AS fate, count(*) AS n FROM {FILES} GROUP BY 1")
def glob_exclude(spark, d):
    return scan.classify(views.files(spark, d), ["1?.*", "*[05].fr"], ["en", "de", "fr"]).groupBy("fate").agg(F.count("*").alias("n"))


@query("SELECT lower(coalesce(regexp_extract(regexp_extract(url, '[^/]*$'), '(\\.[^.]*)$', 1), '')) AS ext, count(*) AS n FROM pages GROUP BY 1")
def extension_counts(spark, d):
    return views.table(spark, d, "pages").groupBy(S.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {DECIDE_SQL} AS matched_rule FROM {MEDIA}")
def rule_decide(spark, d):
    return evaluate.decide(views.media(spark, d), RULES).select("p_partkey", F.col("decision.matched_rule").alias("matched_rule"))


@query(f"SELECT CASE video_codec WHEN 'steel' THEN 'hevc' WHEN 'tin' THEN 'h264' ELSE video_codec END AS codec, count(*) AS n FROM {MEDIA} GROUP BY 1")
def codec_alias(spark, d):
    codec = evaluate.alias_codec(F.col("metadata.video_codec"), {"steel": "hevc", "tin": "h264"})
    return views.media(spark, d).groupBy(codec.alias("codec")).agg(F.count("*").alias("n"))


@query(f"SELECT resolution, count(*) AS n FROM {MEDIA} GROUP BY 1")
def resolution_tag(spark, d):
    return views.media(spark, d).groupBy(F.col("metadata.resolution").alias("resolution")).agg(F.count("*").alias("n"))


@query("""SELECT f AS pix_fmt, CASE WHEN contains(f, '12') THEN 12 WHEN contains(f, '10') THEN 10 ELSE 8 END AS depth,
    CASE WHEN contains(f, '444') THEN '4:4:4' WHEN contains(f, '422') THEN '4:2:2' WHEN contains(f, '410') THEN '4:1:0' ELSE '4:2:0' END AS chroma,
    contains(f, '16') OR contains(f, '10') OR contains(f, '12') OR contains(f, '444') AS review, count(*) AS n
    FROM (SELECT ['nv12', 'yuv410p', 'yuv444p', 'yuv422p', 'yuv420p10le'][CAST(p_partkey % 5 AS INT) + 1] AS f FROM part) GROUP BY ALL""")
def pixfmt_review(spark, d):
    names = F.array(*[F.lit(x) for x in ("nv12", "yuv410p", "yuv444p", "yuv422p", "yuv420p10le")])
    p = views.table(spark, d, "part").select(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("pix_fmt"))
    f = F.col("pix_fmt")
    return p.groupBy("pix_fmt", S.bit_depth(f).alias("depth"), S.chroma(f).alias("chroma"), S.pix_fmt_review(f).isNotNull().alias("review")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, CASE video_codec WHEN 'steel' THEN 'Steel' WHEN 'tin' THEN 'TIN' ELSE 'first' END AS preset_name FROM {MEDIA}")
def preset_lookup(spark, d):
    presets = spark.createDataFrame([("Steel",), ("TIN",)], "name string")
    return evaluate.with_presets(views.media(spark, d), presets, "first", F.col("metadata.video_codec")).select("p_partkey", "preset_name")


@query(f"""SELECT p_partkey, CASE WHEN video_codec = 'tin' THEN 'Tin' ELSE 'STEEL' END AS name, CASE WHEN video_codec = 'tin' THEN 30 ELSE 18 END AS crf, 'balanced-hevc' AS none, 22 AS none_crf FROM {MEDIA}""")
def preset_select(spark, d):
    """By name whatever its case, the first where there is none of that name, the built-in one where none is configured."""
    name = F.col("metadata.video_codec")
    presets = [evaluate.Preset("STEEL", "hevc", 18), evaluate.Preset("Tin", "av1", 30), evaluate.Preset("tin", "h264", 31)]
    some = evaluate.select_preset(views.media(spark, d), presets, name).withColumnRenamed("preset", "some")
    both = evaluate.select_preset(some, [], name)
    return both.select("p_partkey", F.col("some.name").alias("name"), F.col("some.quality_crf").alias("crf"), F.col("preset.name").alias("none"), F.col("preset.quality_crf").alias("none_crf"))


# A conversation as a probed file: a film stream and, of its turns, audio (user), subtitle (assistant) and
# cover (system) streams.
TRACKS = """(SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, n) AS INT) AS idx, ['eng', '', 'fra'][CAST(turn % 3 AS INT) + 1] AS lang,
    ['TrueHD', 'AAC', 'ac3'][CAST(n % 3 AS INT) + 1] AS codec, CAST(n % 9 AS INT) AS channels FROM (SELECT conv_id, turn, role, len(text) AS n FROM conversations))"""
FILMS = f"""(SELECT *, {SIZES} AS resolution, CASE WHEN video_codec = 'hevc' THEN 'modern' WHEN video_codec = 'h264' AND ({SIZES}) IN ('1080p', '4k') THEN 'big' ELSE 'default' END AS rule
    FROM (SELECT DISTINCT conv_id, ['h264', 'hevc', 'vp9'][CAST(conv_id % 3 AS INT) + 1] AS video_codec, CAST(640 + conv_id % 40 * 80 AS INT) AS w, CAST(360 + conv_id % 40 * 45 AS INT) AS h FROM conversations))"""
KEPT = f"""(SELECT t.*, rule, lower(codec) AS c, row_number() OVER (PARTITION BY t.conv_id ORDER BY idx) - 1 AS i, codec = 'TrueHD' OR channels >= 6 OR rule <> 'big' AS copied
    FROM {TRACKS} t JOIN {FILMS} f ON f.conv_id = t.conv_id WHERE role = 'user' AND (lang IN ('', 'eng') OR turn = 0))"""
PLANS = f"""(SELECT f.*, coalesce(n_audio, 0) AS n_audio, coalesce(n_subs, 0) AS n_subs, rule <> 'modern' AND coalesce(n_subs, 0) > 0 AS subs, pics, pic_notes, maps, args, notes, coalesce(kept, 0) AS kept, lossless, surround FROM {FILMS} f
    LEFT JOIN (SELECT conv_id, count(*) FILTER (role = 'user') AS n_audio, count(*) FILTER (role = 'assistant') AS n_subs, string_agg('-map -0:v:' || idx, ' ' ORDER BY idx) FILTER (role NOT IN ('user', 'assistant')) AS pics,
        string_agg('Exclude attached pic: 0:v:' || idx, ' | ' ORDER BY idx) FILTER (role NOT IN ('user', 'assistant')) AS pic_notes, bool_or(codec = 'TrueHD') FILTER (role = 'user') AS lossless, bool_or(channels >= 6) FILTER (role = 'user') AS surround FROM {TRACKS} GROUP BY 1) n ON n.conv_id = f.conv_id
    LEFT JOIN (SELECT conv_id, count(*) AS kept, string_agg('-map 0:' || idx, ' ' ORDER BY idx) AS maps,
        string_agg('-c:a:' || i || CASE WHEN copied THEN ' copy' ELSE ' aac -b:a:' || i || ' 192k -ac:' || i || ' 2' END, ' ' ORDER BY idx) AS args,
        string_agg('Audio #' || idx || ' (' || c || CASE WHEN codec = 'TrueHD' OR channels >= 6 OR rule = 'default' THEN ', ' || channels || 'c): copy' WHEN rule = 'big' THEN '): re-encode aac stereo' ELSE '): copy' END, ' | ' ORDER BY idx) AS notes FROM {KEPT} GROUP BY 1) k ON k.conv_id = f.conv_id)"""


def _planned(spark, d):
    """The library's path from probe document to stream plan, over conversations."""
    t = views.table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("n")).alias("t"))
    files = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("tracks"))  # a file's own few tracks
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    kind = lambda t: F.when(t["role"] == "user", "audio").when(t["role"] == "assistant", "subtitle").otherwise("video")
    name = lambda t: F.when(t["role"] == "user", pick(("TrueHD", "AAC", "ac3"), t["n"] % 3)).when(t["role"] == "assistant", "SubRip").otherwise("PNG")
    tracks = F.transform(
        "tracks",
        lambda t, i: F.struct(
            (i + 1).cast("int").alias("index"), name(t).alias("codec_name"), kind(t).alias("codec_type"), (t["n"] % 9).cast("int").alias("channels"), F.concat((t["n"] % 9).cast("string"), F.lit("c")).alias("channel_layout"),
            F.create_map(F.lit("language"), pick(("eng", "", "fra"), t["turn"] % 3)).alias("tags"), F.create_map(F.lit("default"), (t["turn"] == 0).cast("int")).alias("disposition"),
        ),
    )
    c = F.col("conv_id")
    film = F.struct(F.lit(0).alias("index"), pick(("AVC1", "hevc", "vp9"), c % 3).alias("codec_name"), F.lit("video").alias("codec_type"), (640 + c % 40 * 80).cast("int").alias("width"), (360 + c % 40 * 45).cast("int").alias("height"), pick(("yuv420p10le", "yuv444p"), c % 2).alias("pix_fmt"), pick(("smpte2084", "arib-std-b67", "bt709"), c % 3).alias("color_transfer"))
    about = F.struct(F.lit("matroska").alias("format_name"), F.concat(c.cast("string"), F.lit(".5")).alias("duration"), F.when(c % 5 == 0, "N/A").otherwise((c * 1000).cast("string")).alias("bit_rate"))
    # Streams of two kinds of structs meet as JSON text, which is what a prober gives.
    streams = F.concat(F.lit("["), F.concat_ws(",", F.array(F.to_json(film)), F.transform(tracks, lambda x: F.to_json(x))), F.lit("]"))
    probes = files.select("conv_id", F.concat(F.lit('{"streams":'), streams, F.lit(',"format":'), F.to_json(about), F.lit("}")).alias("json"))
    rules = [Rule("big", 50, {"codec": "h264", "resolution": "1080p, 4K"}, "transcode", "balanced", "aac_stereo", True), Rule("modern", 100, {"codec": "hevc"}, "skip", "", "", False)]
    meta = evaluate.normalize(evaluate.read_probe_json(probes), {"avc1": "h264"})
    return evaluate.stream_plan(evaluate.decide(meta, rules, "copy"), evaluate.AudioPolicy(("ENG",), True, True))


@query(f"SELECT conv_id, concat_ws(' | ', 'Video: 0:v:0', pic_notes, CASE WHEN n_audio = 0 THEN 'Audio: none' ELSE notes END, CASE WHEN subs THEN 'Subtitles: ' || n_subs || ' tracks preserved via copy' END) AS summary FROM {PLANS}")
def stream_plan_summary(spark, d):
    return _planned(spark, d).select("conv_id", F.col("plan.summary").alias("summary"))


@query(f"SELECT conv_id, concat_ws(' ', '-map 0:v:0', pics, maps, CASE WHEN subs THEN '-map 0:s' END) AS maps, coalesce(args, '') AS audio, CASE WHEN subs THEN '-c:s copy' ELSE '' END AS subtitles FROM {PLANS}")
def stream_plan_arguments(spark, d):
    p = F.col("plan")
    return _planned(spark, d).select("conv_id", F.array_join(p["map_args"], " ").alias("maps"), F.array_join(p["audio_codec_args"], " ").alias("audio"), F.array_join(p["subtitle_args"], " ").alias("subtitles"))


@query(f"SELECT conv_id, kept FROM {PLANS}")
def audio_filter(spark, d):
    copied = F.filter(F.col("plan.audio_codec_args"), lambda x: x.startswith("-c:a:"))
    return _planned(spark, d).select("conv_id", F.size(copied).cast("long").alias("kept"))


@query(f"""SELECT conv_id, video_codec, resolution, CASE conv_id % 2 WHEN 0 THEN 10 ELSE 8 END AS bit_depth, CASE conv_id % 2 WHEN 0 THEN '4:2:0' ELSE '4:4:4' END AS chroma, CASE conv_id % 3 WHEN 0 THEN 'hdr10' WHEN 1 THEN 'hlg' ELSE 'none' END AS hdr,
    conv_id % 3 < 2 AS is_hdr, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE conv_id * 1000 END AS bitrate, conv_id + 0.5::DOUBLE AS duration, n_audio || ' tracks' AS audio, n_subs || ' tracks' AS subtitles,
    coalesce(lossless, false) AS has_lossless, coalesce(surround, false) AS has_surround FROM {PLANS}""")
def probe_normalize(spark, d):
    m = F.col("metadata")
    same = ("video_codec", "resolution", "bit_depth", "chroma", "hdr", "is_hdr", "bitrate", "duration", "has_lossless", "has_surround")
    return _planned(spark, d).select("conv_id", *[m[c].alias(c) for c in same], S.track_count(m["audio"]).alias("audio"), S.track_count(m["subtitles"]).alias("subtitles"))


@query(f"SELECT conv_id, rule AS matched_rule, CASE rule WHEN 'modern' THEN 'skip' WHEN 'big' THEN 'transcode' ELSE 'copy' END AS action, CASE rule WHEN 'big' THEN 'balanced' ELSE '' END AS preset FROM {PLANS}")
def probe_decide(spark, d):
    e = F.col("decision")
    return _planned(spark, d).select("conv_id", *[e[c].alias(c) for c in ("matched_rule", "action", "preset")])


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def payload_extract(spark, d):
    e = audit.parse_payload(views.table(spark, d, "events"), "k bigint", "props")
    return e.groupBy("event_type").agg(F.sum("payload.k").alias("k"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey AS queue_id, l_partkey AS orig_size, CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS new_size, l_partkey - l_suppkey AS saved_bytes, l_quantity::DOUBLE AS vmaf,
    CASE WHEN l_linenumber <> 3 THEN l_tax::DOUBLE END AS duration, l_shipmode AS encoder, l_comment AS reason FROM (SELECT *, l_returnflag || '"q"' AS l_comment, l_linestatus AS l_shipmode FROM lineitem)""")
def payload_fields(spark, d):
    """All eight figures of a job's event, written as JSON and read back; what a document lacks is null."""
    c = F.col
    fields = {
        "queue_id": c("l_orderkey"), "orig_size": c("l_partkey"), "new_size": F.when(c("l_linenumber") != 2, c("l_suppkey")), "saved_bytes": c("l_partkey") - c("l_suppkey"), "vmaf": c("l_quantity").cast("double"),
        "duration": F.when(c("l_linenumber") != 3, c("l_tax").cast("double")), "encoder": c("l_linestatus"), "reason": F.concat(c("l_returnflag"), F.lit('"q"')),
    }
    rows = views.table(spark, d, "lineitem").withColumn("payload_json", audit.payload(**fields))
    return audit.parse_payload(rows).select("l_orderkey", "l_linenumber", *[c(f"payload.{k}").alias(k) for k in fields])


@query(f"""SELECT batch, count(*) AS n, count(*) FILTER (event_type = 'job_completed') AS completed, count(*) FILTER (event_type = 'job_failed') AS failed,
    coalesce(sum(saved_bytes) FILTER (event_type = 'job_completed'), 0)::BIGINT AS saved_bytes, round(coalesce(avg(vmaf) FILTER (event_type = 'job_completed' AND vmaf > 0), 0), 6) AS avg_vmaf,
    'Transcode Batch: ' || count(*) || ' processed' AS title FROM
    (SELECT *, (row_number() OVER (ORDER BY seq_id) - 1) // 10 AS batch FROM {AUDIT}) GROUP BY 1""")
def notify_count_batches(spark, d):
    b = audit.count_batches(views.audit(spark, d), 10)
    return audit.summary_message(audit.batch_summary(b, "batch")).select("batch", "n", "completed", "failed", "saved_bytes", F.round("avg_vmaf", 6).alias("avg_vmaf"), "title")


@query(f"SELECT (CAST(floor(epoch(ts)) AS BIGINT) // 1800) * 1800 AS batch, count(*) AS n, count(*) FILTER (event_type = 'job_failed') AS failed FROM {AUDIT} GROUP BY 1")
def notify_time_batches(spark, d):
    b = audit.time_batches(views.audit(spark, d), 1800)
    return audit.batch_summary(b, "batch").select(F.unix_timestamp("batch").alias("batch"), "n", "failed")


@query("""SELECT event_id, floor((epoch_us(after) - epoch_us(ts)) / 1000000)::BIGINT AS silent FROM
    (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE floor((epoch_us(after) - epoch_us(ts)) / 1000000) > 86400""")
def stuck_jobs(spark, d):
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return audit.stuck(e, "user_id", "ts", 86400).filter("is_stuck").select("event_id", "silent")


@query("""SELECT l_orderkey, l_linenumber, round(least(l_quantity / 60.0 * 100, 100), 6) AS pct, round((60.0 - l_quantity) / (1 + l_tax))::BIGINT AS eta FROM lineitem""")
def eta_progress(spark, d):
    cur, total, speed = F.col("l_quantity").cast("double"), F.lit(60.0), 1 + F.col("l_tax")
    pct = S.percentage(cur, total)
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(pct, 6).alias("pct"), S.eta_seconds(cur, total, speed, pct).alias("eta"))


@query("""SELECT passed, reason, count(*) AS n FROM (SELECT NOT (s > 0 AND s < 0.9) AND coalesce(v >= 25.5, true) AS passed, CASE WHEN s > 0 AND s < 0.9 THEN printf('SSIM score %.4f failed quality threshold (minimum 0.90)', s)
    WHEN v >= 25.5 THEN printf('verified: average VMAF %.2f meets threshold 25.50', v) WHEN v IS NOT NULL THEN printf('average VMAF %.2f below configured threshold 25.50', v)
    WHEN s >= 0.92 THEN printf('verified via SSIM score %.4f (libvmaf unavailable for segments)', s) ELSE 'verification completed without fatal error' END AS reason
    FROM (SELECT 1 - l_tax::DOUBLE * 1.7::DOUBLE AS s, CASE WHEN l_linenumber < 6 THEN l_quantity::DOUBLE * 1.0725::DOUBLE END AS v FROM lineitem)) GROUP BY ALL""")
def quality_verdict(spark, d):
    v = quality.verdict(1 - F.col("l_tax").cast("double") * F.lit(1.7), F.when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("double") * F.lit(1.0725)), 25.5)
    return views.table(spark, d, "lineitem").groupBy(v["passed"].alias("passed"), v["reason"].alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, round(avg(q) FILTER (q > 0), 6) AS mean FROM (SELECT l_orderkey, l_quantity::DOUBLE - 10 AS q FROM lineitem) GROUP BY 1""")
def mean_scores(spark, d):
    scores = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double") - 10).alias("scores"))
    return scores.select("l_orderkey", F.round(quality.mean_score(F.col("scores")), 6).alias("mean"))


@query("SELECT '/f/' || o_orderkey AS path FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def signatures_recent(spark, d):
    rows = views.table(spark, d, "orders").select(F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("last_scanned"))
    return dedupe.signatures_since(rows, dt.datetime(1996, 1, 1)).select("path")


RUNNING_SQL = f"SELECT event_type AS channel, round(coalesce(sum(vmaf) FILTER (vmaf > 0), 0), 4) AS sum, count(*) FILTER (vmaf > 0) AS count, round(coalesce(avg(vmaf) FILTER (vmaf > 0), 0), 6) AS mean FROM {AUDIT} GROUP BY 1"


@query(RUNNING_SQL)
def running_vmaf(spark, d):
    rows = stateful.running_mean(views.audit(spark, d).withColumnRenamed("event_type", "channel"))
    return rows.select("channel", F.round("sum", 4).alias("sum"), "count", F.round("mean", 6).alias("mean"))


@query(RUNNING_SQL)
def stream_running_vmaf(spark, d):
    """Sums and counts kept over slices of the events, with a restart after each."""
    rows = views.audit(spark, d).select("seq_id", F.col("event_type").alias("channel"), "vmaf")
    made = streams.replay(in_slices(rows, "seq_id", 3), stateful.running_mean, shared_folder(spark), "complete")
    return made.select("channel", F.round("sum", 4).alias("sum"), "count", F.round("mean", 6).alias("mean"))


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'skipped' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'completed'
    WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN CASE WHEN l_orderkey % 4 < 3 THEN 'pending' ELSE 'permanently_failed' END
    WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 'permanently_failed' WHEN l_returnflag = 'N' AND l_discount = 0 THEN 'skipped'
    WHEN l_returnflag = 'N' AND l_quantity < 10 THEN 'quality_failed' WHEN l_returnflag = 'N' THEN 'completed' ELSE 'review_required' END AS state FROM lineitem) GROUP BY 1""")
def outcome_state(spark, d):
    action = F.when(F.col("l_returnflag") == "A", "skip").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "copy").when(F.col("l_returnflag") == "N", "transcode").otherwise("review")
    error = F.when(F.col("l_linenumber") == 1, "exit 1").when(F.col("l_linenumber") == 2, "got SIGSEGV")
    new = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    growth = quality.grew(F.lit(True), F.col("l_extendedprice"), new)
    no = F.lit(False)
    out = quality.outcome(F.lit("/a/b.mkv"), action, no, F.lit(None).cast("string"), no, growth, F.col("l_quantity") >= 10, error, no, F.col("l_orderkey") % 4)
    return views.table(spark, d, "lineitem").groupBy(out["state"].alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT id, file_path FROM (SELECT id, unnest([file_path, 'relative/' || id]) AS file_path FROM {QUEUE} WHERE scheduled_at <= {NOW_SQL}) WHERE file_path LIKE '/%'")
def schedule_due(spark, d):
    s = views.queue(spark, d).select("id", "priority", F.col("scheduled_at").alias("scheduled"), F.lit(False).alias("executed"), F.array("file_path", F.concat(F.lit("relative/"), F.col("id").cast("string"))).alias("file_paths"))
    return audit.due_paths(s, now()).select("id", "file_path")


@query("""SELECT event_id, w.window, w.edge FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events) e
    JOIN (VALUES ('night', 'start', 120), ('night', 'end', 360), ('late', 'start', 1380), ('late', 'end', 60)) w("window", edge, minute_at) ON e.m = w.minute_at""")
def window_triggers(spark, d):
    e = views.table(spark, d, "events").select("event_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    return audit.window_triggers(e, [("night", 120, 360), ("late", 1380, 60)], F.col("m")).select("event_id", "window", "edge")


@query("SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS grown, count(*) AS n FROM lineitem GROUP BY 1")
def size_growth(spark, d):
    grown = quality.grew(F.lit(True), F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return views.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.when(grown, 1)).alias("grown"), F.count("*").alias("n"))


@query(f"""WITH q AS {QUEUE}, a AS {AUDIT}, f AS (SELECT *, seq > min(seq) OVER (PARTITION BY size, signature) AS dup FROM {FILES})
    SELECT 'x_' || name AS name, type, value::DOUBLE AS value FROM (VALUES ('files_scanned_total', 'counter', (SELECT count(*) FROM f)), ('jobs_submitted_total', 'counter', (SELECT count(*) FROM q)),
    ('jobs_completed_total', 'counter', (SELECT count(*) FROM a WHERE event_type = 'job_completed')), ('jobs_failed_total', 'counter', (SELECT count(*) FROM a WHERE event_type = 'job_failed')),
    ('quality_failed_total', 'counter', (SELECT count(*) FROM a WHERE event_type = 'job_quality_failed')), ('deduplicated_files_total', 'counter', (SELECT count(*) FROM f WHERE dup)),
    ('notifications_sent_total', 'counter', (SELECT count(*) FROM a WHERE seq_id % 3 = 0)), ('queue_pending_depth', 'gauge', (SELECT count(*) FROM q WHERE state = 'pending')),
    ('queue_leased_depth', 'gauge', (SELECT count(*) FROM q WHERE state = 'leased')), ('active_cpu_workers', 'gauge', 0), ('active_gpu_sessions', 'gauge', 0), ('write_actor_queue_size', 'gauge', 0)) m(name, type, value)
    UNION ALL SELECT 'x_vmaf_score_average', 'gauge', round(avg(vmaf), 6) FROM a WHERE event_type = 'job_completed' AND vmaf > 0""")
def metrics_long(spark, d):
    events = views.audit(spark, d)
    sent = events.select(F.when(F.col("seq_id") % 3 == 0, audit.DELIVERED).otherwise(audit.UNDELIVERED).alias("status"))
    m = audit.series(views.queue(spark, d), events, dedupe.mark_duplicates(views.files(spark, d)), sent, "x_")
    return m.select("name", "type", F.round("value", 6).alias("value"))


@query(f"SELECT * FROM (VALUES ('jobs', 'counter', (SELECT count(*)::DOUBLE FROM {QUEUE})), ('events', 'gauge', (SELECT count(*)::DOUBLE FROM events))) m(name, type, value)")
def metrics_json(spark, d):
    """Figures as one JSON text, read back."""
    one = lambda df, name, kind: df.agg(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit("").alias("help"), F.count("*").cast("double").alias("value"))
    made = audit.metrics_json(one(views.queue(spark, d), "jobs", "counter").unionByName(one(views.audit(spark, d), "events", "gauge")))
    return made.select(F.inline(F.from_json("json", "array<struct<name: string, type: string, value: double>>")))


@query("""SELECT p_partkey, CASE WHEN c = 'h264' THEN 'libx264' WHEN c = 'av1' AND g THEN 'hevc_vaapi' WHEN c = 'av1' THEN 'libaom-av1' WHEN g THEN 'hevc_nvenc' ELSE 'libx265' END AS encoder
    FROM (SELECT p_partkey, ['hevc', 'h264', 'av1'][CAST(p_partkey % 3 AS INT) + 1] AS c, p_size > 25 AS g FROM part)""")
def encoder_select(spark, d):
    p = views.table(spark, d, "part")
    codec = F.element_at(F.array(F.lit("hevc"), F.lit("h264"), F.lit("av1")), (F.col("p_partkey") % 3 + 1).cast("int"))
    gpu = F.col("p_size") > 25
    has = F.create_map(F.lit("hevc_nvenc"), gpu, F.lit("hevc_vaapi"), gpu)
    return p.select("p_partkey", evaluate.select_encoder(codec, F.lit("auto"), has)["encoder"].alias("encoder"))


KEY_IN, KEY_OUT = ("".join(f"\\x{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C))
BODY = """'{"event_type":"' || event_type || '","title":"t","message":"m","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}'"""


@query(f"SELECT seq_id, body, sha256('{KEY_OUT}'::BLOB || unhex(sha256('{KEY_IN}'::BLOB || encode(body)))) AS signature FROM (SELECT seq_id, {BODY} AS body FROM {AUDIT})")
def webhook_signatures(spark, d):
    events = views.audit(spark, d).select("seq_id", "event_type", F.lit("t").alias("title"), F.lit("m").alias("message"), F.col("ts").alias("timestamp"))
    return audit.render_message("webhook", events, "secret").select("seq_id", "body", "signature")


@query(f"SELECT id, round(15 * pow(2, retry_count) * (1 + 0.2 * (CAST('0x' || substr(md5(id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0)), 6) AS delay FROM {QUEUE}")
def backoff_jitter(spark, d):
    delay = S.backoff_seconds(F.col("retry_count"), jitter=S.hash_share(F.col("id").cast("string")))
    return views.queue(spark, d).select("id", F.round(delay, 6).alias("delay"))


@query("""SELECT p_partkey, '-hide_banner -y -fflags +genpts+discardcorrupt -err_detect ignore_err -ignore_unknown -thread_queue_size 1024 ' || CASE WHEN e = 'hevc_vaapi' THEN '-vaapi_device /dev/dri/card0 ' ELSE '' END
    || '-i /m/' || p_partkey || '.mkv -map 0:v:0 -map 0:a -map 0:s -c:v ' || e || CASE WHEN e = 'hevc_vaapi' THEN ' -vaapi_device /dev/dri/card0 -vf format=nv12,hwupload' ELSE ' -vf format=yuv420p' END
    || CASE e WHEN 'hevc_nvenc' THEN ' -cq ' || q || ' -preset p5 -spatial-aq 1 -temporal-aq 1' WHEN 'h264_qsv' THEN ' -global_quality ' || q || ' -preset ' || s WHEN 'hevc_amf' THEN ' -rc cqp -qp_p ' || q || ' -qp_i ' || q
       WHEN 'hevc_vaapi' THEN ' -crf ' || q WHEN 'libsvtav1' THEN ' -crf ' || q || ' -preset 6 -svtav1-params tune=0' WHEN 'libx265' THEN ' -crf ' || q || ' -preset ' || s || ' -x265-params no-high-tier=1:no-bframes=4:weightp=0' ELSE ' -crf ' || q || ' -preset ' || s END
    || ' -c:a copy -c:s copy -max_muxing_queue_size 4096 -map_metadata -1 ' || CASE p_partkey % 3 WHEN 0 THEN '-f matroska /o/x.mkv' WHEN 1 THEN '-f mp4 /o/x.MP4' ELSE '/o/x.avi' END AS args
    FROM (SELECT p_partkey, ['hevc_nvenc', 'h264_qsv', 'hevc_amf', 'hevc_vaapi', 'libsvtav1', 'libx265', 'libx264'][CAST(p_partkey % 7 AS INT) + 1] AS e, CASE WHEN p_size % 4 = 0 THEN 22 ELSE p_size END AS q, CASE WHEN p_size % 2 = 0 THEN 'medium' ELSE 'slow' END AS s FROM part)""")
def encoder_command(spark, d):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    encoder = pick(("hevc_nvenc", "h264_qsv", "hevc_amf", "hevc_vaapi", "libsvtav1", "libx265", "libx264"), key % 7)
    none = F.array().cast("array<string>")
    plan = F.struct(none.alias("map_args"), none.alias("audio_codec_args"), none.alias("subtitle_args"))
    args = evaluate.encoder_arguments(encoder, key % 7 < 4, F.concat(F.lit("/m/"), key.cast("string"), F.lit(".mkv")), pick(("/o/x.mkv", "/o/x.MP4", "/o/x.avi"), key % 3), F.when(size % 4 == 0, 0).otherwise(size), F.when(size % 2 == 0, "").otherwise("slow"), plan)
    return views.table(spark, d, "part").select("p_partkey", F.array_join(args, " ").alias("args"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS duration,
    CASE WHEN s = 0 THEN 'Done' WHEN s < 60 THEN '~' || s || 's' WHEN s < 3600 AND s % 60 > 0 THEN '~' || s // 60 || 'm ' || s % 60 || 's' WHEN s < 3600 THEN '~' || s // 60 || 'm' ELSE '~' || s // 3600 || 'h ' || s // 60 % 60 || 'm' END AS eta
    FROM (SELECT *, CAST(l_quantity * l_linenumber * 20 - 20 * l_linenumber AS BIGINT) AS s FROM lineitem)""")
def time_texts(spark, d):
    s = (F.col("l_quantity") * F.col("l_linenumber") * 20 - 20 * F.col("l_linenumber")).cast("long")
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.format_duration(s).alias("duration"), S.format_eta(s).alias("eta"))


@query("""SELECT audit, notice, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'job_skipped' WHEN l_returnflag = 'R' THEN NULL WHEN l_tax = 0 THEN 'job_pixfmt_review' WHEN l_tax = 0.01 THEN 'job_skipped_precheck'
    WHEN l_quantity < 10 THEN 'job_crash' WHEN l_quantity < 20 AND l_orderkey % 4 < 3 THEN NULL WHEN l_quantity < 20 THEN 'job_failed' WHEN l_discount = 0 THEN 'job_skipped_growth' WHEN l_linenumber = 3 THEN 'job_quality_failed' ELSE 'job_completed' END AS audit,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'job_skipped' WHEN l_returnflag = 'R' THEN NULL WHEN l_tax = 0 THEN NULL WHEN l_tax = 0.01 THEN 'job_skipped_precheck'
    WHEN l_quantity < 10 THEN 'job_failed' WHEN l_quantity < 20 AND l_orderkey % 4 < 3 THEN 'job_retried' WHEN l_quantity < 20 THEN 'job_failed' WHEN l_discount = 0 THEN 'job_skipped_growth' WHEN l_linenumber = 3 THEN 'job_quality_failed' ELSE 'job_completed' END AS notice FROM lineitem) GROUP BY ALL""")
def outcome_events(spark, d):
    c = F.col
    action = F.when(c("l_linenumber") == 7, "other").when(c("l_returnflag") == "A", "skip").when(c("l_returnflag") == "R", "review").otherwise("transcode")
    error = F.when(c("l_quantity") < 10, "core dumped").when(c("l_quantity") < 20, "exit 1")
    out = quality.outcome(
        F.lit("/a/b.mkv"), action, F.lit(False), F.when(c("l_tax") == 0, "10-bit"), c("l_tax") == 0.01, c("l_discount") == 0, c("l_linenumber") != 3, error, F.lit(False), c("l_orderkey") % 4,
    )
    return views.table(spark, d, "lineitem").groupBy(out["audit"].alias("audit"), out["notice"].alias("notice")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {DECIDE_SQL} AS matched_rule FROM {MEDIA}")
def rule_table(spark, d):
    rows = [(r.name, r.priority, k, *(evaluate.split_list(r.conditions[c]) if c in r.conditions else None for c in ("codec", "resolution")), *(evaluate.parse_bool(r.conditions[c]) if c in r.conditions else None for c in ("is_hdr", "has_surround")), int(r.conditions["min_bitrate"]) if "min_bitrate" in r.conditions else None) for k, r in enumerate(RULES)]
    rules = spark.createDataFrame(rows, "name string, priority int, ord int, codecs array<string>, resolutions array<string>, is_hdr boolean, has_surround boolean, min_bitrate bigint")
    return evaluate.decide_by_table(views.media(spark, d), rules).select("p_partkey", "matched_rule")


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '(\\.[^.]*)$', 1)) AS ext, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem,
    regexp_extract(url, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') || '_transcoded.mkv' AS made FROM pages""")
def path_parts(spark, d):
    u = F.col("url")
    return views.table(spark, d, "pages").select("page_id", S.base_name(u).alias("name"), S.extension(u).alias("ext"), S.stem(u).alias("stem"), S.destination(u, F.lit(False), F.lit(""), F.lit(".mkv")).alias("made"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey AS frames, CAST(l_quantity AS DOUBLE) AS fps, CAST(l_linenumber * 3600 + 60 * (l_orderkey % 60) + 5.25 AS DOUBLE) AS current_sec, CASE WHEN l_linenumber > 1 THEN l_orderkey || 'kbits/s' END AS bitrate FROM lineitem""")
def progress_lines(spark, d):
    c, two = F.col, lambda x: F.lpad(x.cast("string"), 2, "0")
    rows = views.table(spark, d, "lineitem")
    line = F.concat(
        F.lit("frame=  "), c("l_orderkey").cast("string"), F.lit(" fps="), c("l_quantity").cast("double").cast("string"), F.lit(" time="), two(c("l_linenumber")), F.lit(":"), two(c("l_orderkey") % 60),
        F.lit(":05.25"), F.when(c("l_linenumber") > 1, F.concat(F.lit(" bitrate= "), c("l_orderkey").cast("string"), F.lit("kbits/s"))).otherwise(""), F.lit(" speed=2.5x"),
    )
    p = S.progress_fields(line)
    return rows.select("l_orderkey", "l_linenumber", *[p[k].alias(k) for k in ("frames", "fps", "current_sec", "bitrate")])


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN round(l_tax * 10, 2) WHEN 3 THEN l_quantity::DOUBLE WHEN 4 THEN l_quantity::DOUBLE END AS vmaf, CASE l_linenumber WHEN 1 THEN l_quantity::DOUBLE END AS ssim FROM lineitem""")
def score_extract(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double").cast("string")
    text = F.when(n == 1, F.concat(F.lit("SSIM Y:1 All:"), q)).when(n == 2, F.concat(F.lit("x\nVMAF score: "), F.round(F.col("l_tax") * 10, 2).cast("double").cast("string"))).when(n == 3, F.concat(F.lit("[libvmaf] vmaf mean score: "), q)).when(n == 4, F.concat(F.lit("a 7\nvmaf  score: "), q, F.lit(" end"))).otherwise(F.concat(F.lit("score: "), q))
    rows = views.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", quality.extract_score(text, "vmaf").alias("vmaf"), quality.extract_score(text, "ssim").alias("ssim"))


@query("SELECT count(*) AS n, sum(orderkeys)::BIGINT AS keys FROM (SELECT c_custkey, max(o_orderkey) AS orderkeys FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1)")
def signature_upsert(spark, d):
    key = lambda x: F.concat(F.lit("/f/"), x.cast("string"))
    blob, at = F.encode(F.lit("h"), "UTF-8"), lambda x: F.timestamp_seconds(x)
    old = views.table(spark, d, "customer").select(key(F.col("c_custkey")).alias("path"), F.lit(None).cast("bigint").alias("size"), blob.alias("first_mb_hash"), blob.alias("last_mb_hash"), at(F.lit(0)).alias("first_seen"), at(F.lit(0)).alias("last_scanned"))
    new = views.table(spark, d, "orders").groupBy(key(F.col("o_custkey")).alias("path")).agg(F.max("o_orderkey").alias("size")).select("path", "size", blob.alias("first_mb_hash"), blob.alias("last_mb_hash"), F.lit(None).cast("timestamp").alias("first_seen"), at(F.lit(0)).alias("last_scanned"))
    table = dedupe.upsert_signatures(old, new, now())
    left = dedupe.delete_signatures(table, views.table(spark, d, "customer").filter("c_custkey % 7 = 0").select(key(F.col("c_custkey")).alias("path")))
    return left.agg(F.count("*").alias("n"), F.sum("size").alias("keys"))


def pick(names, k):
    """The k-th of literal names, a null name included."""
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (k + 1).cast("int"))


NUMBERS = ("", "N/A", "1.5", "+7", "-99999999999999999999", "99999999999999999999", "x1")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN 7 WHEN 4 THEN -9223372036854775808 WHEN 5 THEN 9223372036854775807 WHEN 7 THEN p_partkey ELSE 0 END::BIGINT AS whole,
    CASE p_partkey % 8 WHEN 2 THEN 1.5 WHEN 3 THEN 7 WHEN 4 THEN -1e20 WHEN 5 THEN 1e20 WHEN 7 THEN p_partkey ELSE 0 END::DOUBLE AS real FROM part""")
def number_texts(spark, d):
    k = F.col("p_partkey") % 8
    text = F.when(k == 7, F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" "))).otherwise(pick((*NUMBERS, ""), k))
    return views.table(spark, d, "part").select("p_partkey", S.parse_bitrate(text).alias("whole"), S.parse_float(text).alias("real"))


@query("""SELECT p_partkey, array_to_string(x, '|') AS items, array_to_string(list_transform(x, lambda i: CASE WHEN starts_with(i, '.') THEN i ELSE '.' || i END), '|') AS dotted,
    CASE WHEN p_partkey % 5 = 0 THEN 'All files' ELSE 'codec=' || p_brand || ', min_bitrate=' || p_size END AS conditions
    FROM (SELECT *, list_filter(list_transform(string_split(replace(p_type, ' ', ' ,.') || ',, ', ','), lambda i: lower(trim(i))), lambda i: i <> '') AS x FROM part)""")
def comma_lists(spark, d):
    text = F.concat(F.replace("p_type", F.lit(" "), F.lit(" ,.")), F.lit(",, "))
    conditions = F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("min_bitrate"), F.col("p_size").cast("string"), F.lit("codec"), F.col("p_brand")))
    return views.table(spark, d, "part").select("p_partkey", F.array_join(S.split_comma(text), "|").alias("items"), F.array_join(S.dotted_extensions(text), "|").alias("dotted"), S.conditions_text(conditions).alias("conditions"))


CODECS = ("TrueHD", "dts-hd ma", "FLAC", "pcm_s16le", "alac", "aac", "PNG", "mjpeg", "Bmp", "h264", None)


@query("SELECT p_partkey, p_partkey % 11 < 5 AS lossless, p_partkey % 11 IN (6, 7, 8) AS picture FROM part")
def codec_flags(spark, d):
    codec = pick(CODECS, F.col("p_partkey") % len(CODECS))
    return views.table(spark, d, "part").select("p_partkey", S.is_lossless_audio(codec).alias("lossless"), S.is_attached_picture(codec).alias("picture"))


@query("""SELECT p_partkey, CASE WHEN t = 0 OR p = 0 THEN CASE WHEN s < 2 THEN 'dolby_vision' ELSE 'hdr10' END WHEN t = 1 THEN 'hlg' ELSE 'none' END AS hdr
    FROM (SELECT p_partkey, p_partkey % 4 AS t, p_partkey % 3 AS p, p_partkey % 5 AS s FROM part)""")
def hdr_kinds(spark, d):
    k = F.col("p_partkey")
    kind = pick(("DOVI configuration record", "Dolby Vision metadata", "Mastering display", None, "Content light"), k % 5)
    side = F.when(k % 5 < 4, F.array(F.struct(kind.alias("side_data_type"))))
    found = S.hdr_kind(pick(("smpte2084", "arib-std-b67", "bt709", None), k % 4), pick(("bt2020", "bt709", None), k % 3), side)
    return views.table(spark, d, "part").select("p_partkey", found.alias("hdr"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '([_*\[`])', '\\\1', 'g')) AS markdown,
    sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html
    FROM (SELECT doc_id, text || ' _a* [b] `c` <d> & "e" ''f''' AS text FROM documents)""")
def escaped_texts(spark, d):
    text = F.concat("text", F.lit(" _a* [b] `c` <d> & \"e\" 'f'"))
    return views.table(spark, d, "documents").select("doc_id", F.sha2(S.escape_markdown(text), 256).alias("markdown"), F.sha2(S.escape_html(text), 256).alias("html"))


@query(f"""SELECT event_type, CASE event_type WHEN 'job_completed' THEN 'Completed' WHEN 'job_failed' THEN 'Failed' WHEN 'job_skipped_growth' THEN 'Skipped' ELSE event_type END AS title,
    CASE WHEN event_type LIKE '%failed%' THEN 15158332 WHEN event_type LIKE '%skipped%' THEN 15844367 ELSE 3066993 END AS color,
    CASE WHEN event_type LIKE '%failed%' THEN 8 ELSE 5 END AS priority, count(*) AS n FROM {AUDIT} GROUP BY ALL""")
def event_styles(spark, d):
    e = F.col("event_type")
    return views.audit(spark, d).groupBy(e, S.event_title(e).alias("title"), S.event_color(e).alias("color"), S.gotify_priority(e).alias("priority")).agg(F.count("*").alias("n"))


STATES = ("pending", "leased", "evaluating", "transcoding", "processing", "paused", "failed", "quality_failed", "permanently_failed", "skipped", "completed", "review_required")


@query("SELECT o_orderkey, o_orderkey % 12 < 5 AS can_pause, o_orderkey % 12 BETWEEN 5 AND 9 AS can_resume FROM orders")
def state_actions(spark, d):
    state = pick(STATES, F.col("o_orderkey") % len(STATES))
    return views.table(spark, d, "orders").select("o_orderkey", S.can_pause(state).alias("can_pause"), S.can_resume(state).alias("can_resume"))


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN p_type WHEN k = 2 THEN CASE WHEN length(t) > 70 THEN t[1:70] || '...' ELSE t END ELSE 'Transcode execution failed' END AS line, right(p_type, 7) AS tail
    FROM (SELECT *, p_partkey % 4 AS k, rtrim(repeat(p_type || ' ', 4)) AS t FROM part)""")
def error_lines(spark, d):
    k, t = F.col("p_partkey") % 4, F.col("p_type")
    text = F.when(k == 0, "").when(k == 1, F.concat(F.lit("\n \n  "), t, F.lit(" \t\nerror: later"))).when(k == 2, F.repeat(F.concat(t, F.lit(" ")), F.lit(4)))
    return views.table(spark, d, "part").select("p_partkey", S.first_error_line(text).alias("line"), S.tail_bytes(t, 7).cast("string").alias("tail"))


@query("""SELECT l_orderkey, l_linenumber, (h * 3600 + m * 60 + 5.25)::DOUBLE AS seconds, CASE WHEN h < 24 AND m < 60 THEN h * 60 + m END::INT AS minute
    FROM (SELECT *, l_linenumber * 4 AS h, l_orderkey % 70 AS m FROM lineitem)""")
def clock_texts(spark, d):
    text = F.format_string("%02d:%02d", F.col("l_linenumber") * 4, F.col("l_orderkey") % 70)
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clock_seconds(F.concat(text, F.lit(":05.25"))).alias("seconds"), S.clock_minutes(text).alias("minute"))


def size_sql(n: str) -> str:
    """A size's text in SQL, whose ``printf`` rounds from the exact value."""
    steps = " ".join(f"WHEN {n} >= {1024**k} THEN printf('%.2f {u}B', {n} / {1024**k}::DOUBLE)" for k, u in reversed(list(enumerate("KMGTPE", 1))))
    return f"CASE {steps} ELSE {n} || ' B' END"


@query(f"""SELECT l_orderkey, l_linenumber, {size_sql('n')} AS text FROM (SELECT *, CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey * l_suppkey WHEN 3 THEN l_partkey * 128 WHEN 4 THEN l_orderkey * 131072 ELSE l_orderkey * l_partkey * l_suppkey * 1048576 END AS n FROM lineitem)""")
def size_texts(spark, d):
    """Sizes of every unit, ties of rounding among them."""
    n, o, p, s = (F.col(f"l_{c}") for c in ("linenumber", "orderkey", "partkey", "suppkey"))
    wide = o.cast("decimal(38,0)")  # the product of three keys passes 64 bits
    size = F.when(n == 1, p).when(n == 2, p * s).when(n == 3, p * 128).when(n == 4, o * 131072).otherwise(wide * p * s * 1048576)
    return views.table(spark, d, "lineitem").select(o, n, S.format_bytes(size).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, a - b AS saved, CASE WHEN a > 0 THEN (a - b)::DOUBLE / a * 100 ELSE 0 END AS share, CASE WHEN a > 0 THEN b::DOUBLE / a ELSE 0 END AS ratio, 95 + l_linenumber::DOUBLE / 7 * 4 AS pct
    FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_partkey END AS a, l_suppkey AS b FROM lineitem)""")
def saved_figures(spark, d):
    n, new = F.col("l_linenumber"), F.col("l_suppkey")
    old = F.when(n == 7, 0).otherwise(F.col("l_partkey"))
    return views.table(spark, d, "lineitem").select(
        "l_orderkey", n, S.saved_bytes(old, new).alias("saved"), S.saved_share(old, new).alias("share"),
        S.compression_ratio(old, new).alias("ratio"), S.segment_percentage(n, F.lit(7)).alias("pct"),
    )


@query("""SELECT l_orderkey, l_linenumber, len(p) AS points, round(l_orderkey * p[1], 6)::DOUBLE AS first, round(l_orderkey * p[len(p)], 6)::DOUBLE AS last, l_quantity >= 25 AND l_linenumber >= 6 AS passes
    FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN [0.5] WHEN l_linenumber <= 3 THEN [0.15, 0.5, 0.85] ELSE [0.1, 0.3, 0.5, 0.7, 0.9] END AS p FROM lineitem)""")
def sample_points(spark, d):
    n = F.col("l_linenumber")
    starts = quality.sample_starts(F.col("l_orderkey").cast("double"), n)
    passes = quality.precheck(F.col("l_quantity"), n / F.lit(6.5), 25.0)
    at = lambda k: F.round(F.element_at(starts, k), 6)
    return views.table(spark, d, "lineitem").select("l_orderkey", n, F.size(starts).cast("long").alias("points"), at(1).alias("first"), at(-1).alias("last"), passes.alias("passes"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN event_id % 3 > 0 THEN event_id END AS job, '/m/' || user_id || '.mkv' AS path, user_id || '.mkv' AS name FROM events""")
def event_names(spark, d):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    job = F.concat(F.when(i % 3 > 0, "job-").otherwise("x-job-"), i.cast("string"), F.lit(".tmp"))
    path, dos = F.concat(F.lit("  /m/./a/../"), u, F.lit(".mkv ")), F.concat(F.lit("C:\\m/b\\"), u, F.lit(".mkv"))
    return views.table(spark, d, "events").select(i, S.rfc3339(F.col("ts").cast("timestamp")).alias("at"), S.job_number(job).alias("job"), S.normalize_path(path).alias("path"), S.any_base_name(dos).alias("name"))


@query("""SELECT doc_id, base64(unhex(sha256(doc_id || 'a'))) AS stored, sha256(unhex(sha256(doc_id || 'a')) || unhex(sha256(doc_id || 'b'))) AS signature FROM documents WHERE doc_id % 5 <> 0""")
def signature_codes(spark, d):
    """Signatures stored as base64, some of them damaged, loaded and put back on files without one."""
    i = F.col("doc_id").cast("string")
    digest = lambda end: F.unhex(F.sha2(F.concat(i, F.lit(end)), 256))
    rows = views.table(spark, d, "documents").select("doc_id", F.concat(F.lit("/"), i).alias("path"), F.lit(1).alias("size"), digest("a").alias("first_mb_hash"), digest("b").alias("last_mb_hash"))
    stored = dedupe.store_signatures(rows).withColumn("stored", F.col("first_mb_hash"))
    damaged = stored.withColumn("first_mb_hash", F.when(F.col("doc_id") % 5 == 0, "***").otherwise(F.col("first_mb_hash")))
    known = dedupe.load_signatures(damaged)
    files = known.select("doc_id", "stored", "path", "size", F.lit(None).cast("string").alias("signature"))
    return dedupe.restore_signatures(files, known).select("doc_id", "stored", "signature")


@query(f"""SELECT b.*, v.avg_vmaf, u.unique_files, 'healthy' AS health, s.savings, e.events FROM
    (SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'completed') AS completed, 0::BIGINT AS failed, count(*) AS total FROM {QUEUE}) b,
    (SELECT round(coalesce(avg(vmaf) FILTER (vmaf > 0), 0), 6) AS avg_vmaf FROM (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 15) WHERE event_type = 'job_completed') v, (SELECT count(DISTINCT size) AS unique_files FROM {FILES}) u,
    (SELECT coalesce(string_agg(seq_id || ':' || saved_bytes, ',' ORDER BY seq_id DESC), '') AS savings FROM (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 15) WHERE event_type = 'job_completed' AND saved_bytes > 0) s,
    (SELECT string_agg(seq_id || ':' || event_type, ',' ORDER BY seq_id DESC) AS events FROM (SELECT * FROM {AUDIT} ORDER BY seq_id DESC LIMIT 20)) e""")
def status_report(spark, d):
    s = api.status(views.queue(spark, d), views.audit(spark, d), views.files(spark, d))
    joined = lambda c, v: F.array_join(F.transform(c, lambda x: F.concat(x["seq_id"].cast("string"), F.lit(":"), x[v].cast("string"))), ",")
    return s.select(
        "pending", "leased", "completed", "failed", "total", F.round("avg_vmaf", 6).alias("avg_vmaf"), "unique_files", "health",
        joined(F.col("recent_savings"), "saved_bytes").alias("savings"), joined(F.col("recent_events"), "event_type").alias("events"),
    )


@query(f"""SELECT q.id, q.state, s.event_type, s.saved_bytes, CASE WHEN q.id % 3 = 0 THEN (q.id % 100)::BIGINT END AS pct FROM (SELECT * FROM {QUEUE} ORDER BY id DESC LIMIT 80) q LEFT JOIN {STATS} s ON s.queue_id = q.id""")
def job_page(spark, d):
    jobs = views.queue(spark, d)
    progress = jobs.filter("id % 3 = 0").select(F.col("id").alias("job_id"), (F.col("id") % 100).alias("pct"))
    return api.queue_page(jobs, views.audit(spark, d), progress, "all", 80).select("id", "state", "event_type", "saved_bytes", "pct")


@query(f"SELECT q.id, q.file_path, c.c_mktsegment AS preset, (q.id % 100)::BIGINT AS pct FROM {QUEUE} q LEFT JOIN customer c ON c.c_custkey = q.id WHERE q.id = 7")
def job_item(spark, d):
    jobs = views.queue(spark, d)
    metadata = views.table(spark, d, "customer").select(F.col("c_custkey").alias("queue_id"), F.col("c_mktsegment").alias("preset"))
    return api.queue_item(jobs, metadata, jobs.select(F.col("id").alias("job_id"), (F.col("id") % 100).alias("pct")), 7).select("id", "file_path", "preset", "pct")


@query("""SELECT path, owner, path = '/n/3' AS found FROM (SELECT '/n/' || c_custkey AS path, CASE WHEN c_custkey = 3 THEN 'new' ELSE c_name END AS owner FROM customer WHERE c_custkey <> 5) UNION ALL SELECT '/n/new', 'new', FALSE""")
def scope_edits(spark, d):
    scopes = views.table(spark, d, "customer").select(F.concat(F.lit("/n/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("owner"))
    added = scopes.filter("path = '/n/3'").select("path", F.lit("new").alias("owner"))
    edited = api.with_scope(scopes, added)
    edited = api.without_scope(api.with_scope(edited, edited.limit(1).select(F.lit("/n/new").alias("path"), F.lit("new").alias("owner"))), "/n/5")
    return edited.join(F.broadcast(api.find_scope(edited, "/n/3").select("path", F.lit(True).alias("found"))), "path", "left").fillna(False, ["found"])


@query(f"""SELECT 's' || o_orderkey AS id, unnest(['/a/' || o_orderkey, '/b/' || o_orderkey]) AS file_path, CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE o_orderkey % 4 END::INT AS priority,
    CASE WHEN o_orderdate > {NOW_SQL} THEN epoch(o_orderdate) ELSE epoch({NOW_SQL}) + 1 END::BIGINT AS at FROM orders WHERE o_orderkey % 5 > 1""")
def schedule_requests(spark, d):
    """Requests as JSON, a fifth of them broken and a fifth without paths."""
    i, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    paths = F.when(n % 5 > 1, F.array(F.concat(F.lit("/a/"), i), F.concat(F.lit("/b/"), i))).otherwise(F.array())
    entry = F.struct(F.concat(F.lit("s"), i).alias("id"), paths.alias("file_paths"), (n % 4).alias("priority"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scheduled"))
    bodies = views.table(spark, d, "orders").select(F.when(n % 5 == 0, "{broken").otherwise(F.to_json(entry)).alias("body"))
    found = audit.read_schedule(bodies, now())
    return found.select("id", F.explode("file_paths").alias("file_path"), "priority", F.unix_timestamp("scheduled").alias("at"))


@query("""SELECT id, file_path, priority, 'due' AS kind FROM (SELECT 's' || c_custkey AS id, '/n/' || c_custkey AS file_path, c_custkey::INT AS priority FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (6, 9))
    UNION ALL SELECT 's4', '/n/4', 75, 'manual' UNION ALL SELECT 's' || c_custkey, '/n/' || c_custkey, c_custkey::INT, 'open' FROM customer WHERE c_custkey % 3 <> 0""")
def schedule_runs(spark, d):
    """Entries due, one triggered by hand, and those still open once the due ones are marked; one was removed."""
    k = F.col("c_custkey")
    at = F.when(k % 3 == 0, now()).otherwise(now() + F.expr("INTERVAL 1 HOUR"))
    rows = views.table(spark, d, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.array(F.concat(F.lit("/n/"), k.cast("string")), F.lit("n/relative")).alias("file_paths"), k.cast("int").alias("priority"), at.alias("scheduled"), (k == 9).alias("executed"))
    kept = audit.remove_schedule(rows, "s6")
    left = audit.mark_executed(kept, now()).filter("NOT executed")
    still = audit.due_paths(audit.list_schedule(left), now() + F.expr("INTERVAL 2 HOURS"))
    parts = [x.select("id", "file_path", "priority", F.lit(kind).alias("kind")) for kind, x in (("due", audit.due_paths(kept, now())), ("manual", audit.trigger_now(kept, "s4")), ("open", still))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, channel, minute FROM (SELECT *, row_number() OVER (PARTITION BY channel, minute ORDER BY ts, event_id) AS k FROM (SELECT event_id, ts, event_type AS channel, epoch(date_trunc('hour', ts))::BIGINT AS minute FROM events)) WHERE k <= 2")
def rate_limited(spark, d):
    """Two messages a minute and channel; times are cut to the hour so that minutes are full."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    e = views.table(spark, d, "events").select("event_id", F.col("event_type").alias("channel"), hour.alias("timestamp"), F.col("ts").cast("timestamp").alias("ts"))
    order = e.withColumn("event_id", F.struct("ts", "event_id"))
    return audit.within_rate(order, 2).select(F.col("event_id.event_id").alias("event_id"), "channel", F.unix_timestamp("timestamp").alias("minute"))


@query("""SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY event_id) AS seq_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'warning' END AS severity, '{"event":' || event_id || '}' AS payload_json, (SELECT count(*) FROM events) AS numbers FROM events""")
def audit_appended(spark, d):
    """Every event appended to the log once more, each with its number, in the order of events; ``numbers``: how many distinct numbers right after the log's last they have."""
    k = F.col("event_id")
    new = views.table(spark, d, "events").select("event_id", "event_type", F.when(k % 2 == 0, "").otherwise("warning").alias("severity"), audit.payload(event=k).alias("payload_json"))
    log = views.audit(spark, d).select("seq_id", F.col("ts").alias("timestamp"), "event_type", F.lit("info").alias("severity"), "payload_json")
    last = log.agg(F.max("seq_id")).first()[0]
    added = audit.append_events(log, new, now(), "event_id").filter(F.col("seq_id") > last)
    n = F.count_distinct("seq_id")
    ends = added.agg(F.when(F.max("seq_id") == last + n, n).alias("numbers"))
    return added.select("seq_id", "event_type", "severity", "payload_json").crossJoin(F.broadcast(ends))  # one row


BATCHES_SQL = f"""(SELECT queue_id, n, completed, failed, saved_bytes, avg_vmaf, 'Transcode Batch: ' || n || ' processed' AS title,
    'Batch finished: ' || completed || ' completed, ' || failed || ' failed. Saved: ' || {size_sql('saved_bytes')} AS message FROM (SELECT queue_id, count(*) AS n, count(*) FILTER (event_type = 'job_completed') AS completed,
    count(*) FILTER (event_type = 'job_failed') AS failed, coalesce(sum(seq_id * 5) FILTER (event_type = 'job_completed'), 0)::BIGINT AS saved_bytes,
    coalesce(max(seq_id % 800) FILTER (event_type = 'job_completed' AND seq_id % 800 > 0), 0) / 8 AS avg_vmaf FROM {AUDIT} GROUP BY 1))"""


def job_batches(spark, d):
    """Figures of each job's events."""
    events = views.audit(spark, d).withColumn("saved_bytes", F.col("seq_id") * 5)
    best = F.max(F.when((F.col("event_type") == "job_completed") & (F.col("seq_id") % 800 > 0), F.col("seq_id") % 800))
    means = events.groupBy("queue_id").agg((F.coalesce(best, F.lit(0)) / 8).alias("avg_vmaf"))
    return audit.batch_summary(events, "queue_id").drop("avg_vmaf").join(means, "queue_id")


@query(f"SELECT queue_id, 'batch_summary' AS event_type, title, message FROM {BATCHES_SQL}")
def batch_messages(spark, d):
    return audit.summary_message(job_batches(spark, d)).select("queue_id", "event_type", "title", "message")


CHANNELS = [
    audit.Channel("chat", "discord"), audit.Channel("team", "slack", ("batch_summary", "job_failed")), audit.Channel("push", "gotify", ("job_failed",)), audit.Channel("phone", "gotify"),
    audit.Channel("bot", "telegram"), audit.Channel("mail", "smtp", ("batch_summary",)), audit.Channel("hook", "webhook", (), "key"),
]
VMAF_SQL = "printf('%.2f', avg_vmaf)"


@query(f"""WITH b AS (SELECT *, queue_id::VARCHAR AS event_id FROM {BATCHES_SQL}),
    p AS (SELECT *, '{{"event_id":"' || event_id || '","event_type":"batch_summary","title":"' || title || '","message":"' || message || '","timestamp":"1998-01-01T00:00:00Z","total_items":' || n
        || CASE WHEN saved_bytes <> 0 THEN ',"saved_bytes":' || saved_bytes ELSE '' END || CASE WHEN avg_vmaf <> 0 THEN ',"average_vmaf":' || avg_vmaf::DOUBLE ELSE '' END || '}}' AS payload FROM b)
    SELECT event_id, channel, CASE channel
        WHEN 'chat' THEN '{{"embeds":[{{"title":"' || title || '","description":"' || message || '","color":3066993,"timestamp":"1998-01-01T00:00:00Z","fields":['
            || concat_ws(',', CASE WHEN saved_bytes > 0 THEN '{{"name":"Saved","value":"' || {size_sql('saved_bytes')} || '"}}' END, CASE WHEN avg_vmaf > 0 THEN '{{"name":"VMAF","value":"' || {VMAF_SQL} || '"}}' END) || ']}}]}}'
        WHEN 'team' THEN '{{"text":"*' || title || '*\\n' || message || '"}}' WHEN 'phone' THEN '{{"title":"' || title || '","message":"' || message || '","priority":5}}'
        WHEN 'bot' THEN '*' || title || '*' || chr(10) || message || CASE WHEN saved_bytes > 0 THEN chr(10) || 'Saved: ' || {size_sql('saved_bytes')} ELSE '' END || CASE WHEN avg_vmaf > 0 THEN chr(10) || 'VMAF: ' || {VMAF_SQL} ELSE '' END
        WHEN 'mail' THEN '<h2>' || title || '</h2><p>' || message || '</p>' ELSE payload END AS body, channel = 'hook' AS signed, payload
    FROM p, (SELECT unnest(['chat', 'team', 'phone', 'bot', 'mail', 'hook']) AS channel)""")
def outbox_bodies(spark, d):
    """A summary for each job, rendered for each channel that takes summaries."""
    summaries = job_batches(spark, d).withColumns({"event_id": F.col("queue_id").cast("string"), "timestamp": now()})
    return audit.outbox(summaries, CHANNELS).select("event_id", "channel", "body", F.col("signature").isNotNull().alias("signed"), "payload")


@query(f"""WITH c AS (SELECT * FROM (VALUES ('discord', ['batch_summary']), ('mail', []::VARCHAR[]), ('gotify', ['job_failed'])) c(channel, events))
    SELECT batch, channel, n FROM (SELECT queue_id % 10 AS batch, count(*) AS n FROM {AUDIT} GROUP BY 1), c WHERE len(events) = 0 OR list_contains(events, 'batch_summary')""")
def channel_fanout(spark, d):
    channels = spark.createDataFrame([("discord", ["batch_summary"]), ("mail", []), ("gotify", ["job_failed"])], "channel string, events array<string>")
    batches = views.audit(spark, d).groupBy((F.col("queue_id") % 10).alias("batch")).agg(F.count("*").alias("n"))
    return audit.for_channels(batches, channels).select("batch", "channel", "n")


@query(f"""SELECT c_custkey, '{{"text":"*' || t || '*\\nm_' || c_custkey || '"}}' AS slack, '{{"title":"' || t || '","message":"m_' || c_custkey || '","priority":' || CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 5 END || '}}' AS gotify,
    '*' || replace(t, '_', '\\_') || '*' || chr(10) || 'm\\_' || c_custkey || CASE WHEN c_custkey > 0 THEN chr(10) || 'Saved: ' || {size_sql('c_custkey * 1024')} || '' ELSE '' END || CASE WHEN c_custkey % 4 > 0 THEN chr(10) || 'VMAF: ' || c_custkey % 4 || '.50' ELSE '' END AS telegram,
    '<h2>' || t || '</h2><p>m_' || c_custkey || '</p>' AS smtp,
    '{{"embeds":[{{"title":"' || t || '","description":"m_' || c_custkey || '","color":' || CASE WHEN c_custkey % 2 = 0 THEN 15158332 ELSE 3066993 END || ',"timestamp":"1998-01-01T00:00:00Z","fields":['
    || concat_ws(',', CASE WHEN c_custkey > 0 THEN '{{"name":"Saved","value":"' || {size_sql('c_custkey * 1024')} || '"}}' END, CASE WHEN c_custkey % 4 > 0 THEN '{{"name":"VMAF","value":"' || c_custkey % 4 || '.50"}}' END) || ']}}]}}' AS discord
    FROM (SELECT *, replace(c_mktsegment || ' a', ' ', '_') AS t FROM customer)""")
def channel_messages(spark, d):
    k = F.col("c_custkey")
    events = views.table(spark, d, "customer").select(
        k, F.replace(F.concat("c_mktsegment", F.lit(" a")), F.lit(" "), F.lit("_")).alias("title"), F.concat(F.lit("m_"), k.cast("string")).alias("message"), now().alias("timestamp"),
        F.when(k % 2 == 0, "job_failed").otherwise("job_completed").alias("event_type"), (k * 1024).cast("long").alias("saved_bytes"),
        F.when(k % 4 > 0, k % 4 + 0.5).otherwise(0.0).cast("double").alias("avg_vmaf"),
    )
    for kind in ("slack", "gotify", "telegram", "smtp", "discord"):
        events = audit.render_message(kind, events).withColumnRenamed("body", kind)
    return events.select("c_custkey", "slack", "gotify", "telegram", "smtp", "discord")


@query(f"""SELECT (SELECT sum(saved_bytes)::BIGINT FROM {AUDIT}) AS total, (SELECT greatest(max(saved_bytes), 1024) FROM {AUDIT}) AS scale, 'degraded' AS health,
    (SELECT '{{"recovered_jobs":' || count(*) || '}}' FROM {QUEUE} WHERE {EXPIRED}) AS recovered, (SELECT max(event_id) FROM events) AS last""")
def report_figures(spark, d):
    events = views.audit(spark, d)
    checks = views.table(spark, d, "region").select(F.when(F.col("r_regionkey") == 2, "degraded").otherwise("healthy").alias("status"))
    recovered = api.recovered_event(views.queue(spark, d), now()).select(F.col("payload_json").alias("recovered"))
    health = audit.worst_health(checks).select(F.col("status").alias("health"))
    last = audit.newest(events, 1).select(F.col("seq_id").alias("last"))
    return audit.chart_scale(events).crossJoin(health).crossJoin(recovered).crossJoin(last)  # a row each
