"""Scalar functions as column expressions (no Python runs for them but for path clean-up)."""

from __future__ import annotations

import hashlib
import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_bitrate(x: Column) -> Column:
    """Whole number in text, 0 when it isn't one; beyond 64 bits the nearest limit."""
    t = F.trim(x)
    is_int = t.rlike("^[+-]?[0-9]+$")
    wide = F.expr("9223372036854775807L")
    low = -wide - F.lit(1)
    value = t.try_cast("bigint")
    clamped = F.when(t.startswith("-"), low).otherwise(wide)
    return F.coalesce(F.when(is_int, F.coalesce(value, clamped)), F.lit(0).cast("bigint"))


def parse_float(x: Column) -> Column:
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))


def split_comma(x: Column) -> Column:
    """Comma list: trimmed, lower-cased, empty items dropped."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def resolution_tag(width: Column, height: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return (
        F.when((w >= 3800) | (h >= 2100), "4k").when((w >= 1900) | (h >= 1000), "1080p")
        .when((w >= 1200) | (h >= 700), "720p").when((w >= 800) | (h >= 450), "480p").otherwise("sd")
    )


def bit_depth(pix_fmt: Column) -> Column:
    """By the digits in the name alone, so ``nv12`` counts as 12 and 16-bit formats as 8."""
    return F.when(pix_fmt.contains("12"), 12).when(pix_fmt.contains("10"), 10).otherwise(8)


def chroma(pix_fmt: Column) -> Column:
    p = F.lower(F.coalesce(pix_fmt, F.lit("")))
    found = F.lit("4:2:0")
    for part, name in reversed((("444", "4:4:4"), ("422", "4:2:2"), ("410", "4:1:0"), ("420", "4:2:0"), ("gray", "4:0:0"), ("mono", "4:0:0"))):
        found = F.when(p.contains(part), name).otherwise(found)
    return found


#: Why a pixel format wants a review, by a part of its name.
REVIEW_REASONS = {
    "16": "16-bit pixel format (%s) not supported by x265; manual review required",
    "10": "10-bit pixel format (%s) will lose quality converting to 8-bit yuv420p",
    "12": "12-bit pixel format (%s) will lose significant quality converting to 8-bit yuv420p",
    "444": "4:4:4 chroma subsampling (%s) may cause decoder issues and loses chroma detail converting to 4:2:0",
}


def pix_fmt_review(pix_fmt: Column) -> Column:
    """Reason for a manual review of a pixel format, or null; of several the first listed."""
    p, found = F.lower(pix_fmt), F.lit(None).cast("string")
    for part, reason in reversed(REVIEW_REASONS.items()):
        found = F.when(p.contains(part), F.format_string(reason, pix_fmt)).otherwise(found)
    return found


def hdr_kind(transfer: Column, primaries: Column, side_data: Column) -> Column:
    """Wide primaries come before the HLG transfer, so HLG with 2020 primaries is ``hdr10``."""
    kinds = F.transform(F.coalesce(side_data, F.array()), lambda m: F.lower(F.coalesce(m["side_data_type"], F.lit(""))))
    dolby = F.exists(kinds, lambda k: k.contains("dovi") | k.contains("dolby"))
    wide = (transfer == "smpte2084") | F.coalesce(primaries.contains("2020"), F.lit(False))
    return F.when(F.coalesce(wide, F.lit(False)), F.when(dolby, "dolby_vision").otherwise("hdr10")).when(transfer == "arib-std-b67", "hlg").otherwise("none")


def is_lossless_audio(codec: Column) -> Column:
    return F.coalesce(F.lower(codec).rlike("truehd|dts-hd|flac|pcm|alac"), F.lit(False))


def is_attached_picture(codec: Column) -> Column:
    return F.coalesce(F.lower(codec).isin("png", "jpeg", "jpg", "bmp", "mjpeg"), F.lit(False))


def fixed(x: Column, decimals: int) -> Column:
    """A number's text with so many decimals, rounded from its exact binary value, ties to even (``format_string``
    rounds the shortest decimal form up, so that 1.005 would read 1.01)."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * decimals))


def format_bytes(n: Column) -> Column:
    """A size with its unit; also one past 64 bits, as a decimal, in EB."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**k, F.concat(fixed(n / 1024.0**k, 2), F.lit(f" {unit}B"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``h:mm:ss``, below an hour ``mm:ss``; none or negative: ``00:00``."""
    s = F.greatest(F.coalesce(F.floor(seconds).cast("long"), F.lit(0)), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def format_eta(seconds: Column) -> Column:
    """Whole seconds as the time still to go: ``--`` when unknown, ``Done``, ``~Ns``, ``~Nm Ns`` or ``~Nh Nm``."""
    s = seconds.cast("long")
    m, left = F.floor(s / 60), s % 60
    minutes = F.concat(F.lit("~"), m.cast("string"), F.lit("m"), F.when(left > 0, F.concat(F.lit(" "), left.cast("string"), F.lit("s"))).otherwise(""))
    hours = F.format_string("~%dh %dm", F.floor(m / 60), m % 60)
    return (
        F.when(s.isNull() | (s < 0), "--").when(s == 0, "Done").when(s < 60, F.format_string("~%ds", s))
        .when(m < 60, minutes).otherwise(hours)
    )


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, "([_*\\[`])", "\\\\$1")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def any_base_name(path: Column) -> Column:
    """After the last slash or backslash."""
    return F.regexp_extract(path, "[^/\\\\]*$", 0)


def dir_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; '' without one."""
    return F.lower(F.regexp_extract(base_name(path), "(\\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def destination(path: Column, in_place: Column, suffix: Column, ext: Column) -> Column:
    made = F.concat(dir_name(path), F.lit("/"), stem(path), F.when(F.coalesce(suffix, F.lit("")) == "", "_transcoded").otherwise(suffix), ext)
    return F.when(in_place, path).otherwise(made)


def clock_seconds(text: Column) -> Column:
    """``hh:mm:ss.frac`` in seconds; null when it isn't one."""
    part = lambda k: F.regexp_extract(text, "^(\\d+):(\\d+):(\\d+(?:\\.\\d+)?)$", k)
    return part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")


def clock_minutes(text: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` as the minute of the day; null when out of range."""
    ok = text.rlike("^\\d{1,2}:\\d{1,2}(:\\d{1,2})?$")
    h = F.when(ok, F.split(text, ":")[0].try_cast("int"))
    m = F.when(ok, F.split(text, ":")[1].try_cast("int"))
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)


def progress_fields(line: Column) -> Column:
    """Struct of an encoder's statistics line; null unless it has ``frame=`` or ``time=``."""
    grab = lambda p: F.regexp_extract(line, p, 1)
    fields = F.struct(
        grab("frame=\\s*(\\d+)").try_cast("bigint").alias("frames"),
        grab("fps=\\s*([\\d.]+)").try_cast("double").alias("fps"),
        clock_seconds(grab("time=\\s*(\\d+:\\d+:\\d+(?:\\.\\d+)?)")).alias("current_sec"),
        F.nullif(grab("bitrate=\\s*([^\\s]+)"), F.lit("")).alias("bitrate"),
        grab("speed=\\s*([\\d.]+)x").try_cast("double").alias("speed"),
    )
    return F.when(line.contains("frame=") | line.contains("time="), fields)


def percentage(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(current / total * 100, F.lit(100.0))).otherwise(0.0)


def eta_seconds(current: Column, total: Column, speed: Column, pct: Column) -> Column:
    """Rounded while something is left and the speed is known, then 0 near the end; null where the last value holds on."""
    return F.when((speed > 0) & (total > current), F.round((total - current) / speed).cast("long")).when(pct >= 99.9, F.lit(0).cast("long"))


def segment_percentage(i: Column, n: Column) -> Column:
    return 95 + i / n * 4


def saved_bytes(orig: Column, new: Column) -> Column:
    return orig - new


def saved_share(orig: Column, new: Column) -> Column:
    """Per cent of the original size that was saved; 0 without an original size."""
    return F.when(orig > 0, (orig - new) / orig * 100).otherwise(0.0)


def compression_ratio(orig: Column, new: Column) -> Column:
    return F.when(orig > 0, new / orig).otherwise(0.0)


def backoff_seconds(retry: Column, base: float = 15.0, jitter: Column | None = None) -> Column:
    """base * 2^retry, with up to a fifth more by ``jitter`` (a column in [0, 1))."""
    delay = F.lit(base) * F.pow(F.lit(2.0), retry)
    return delay if jitter is None else delay * (1 + 0.2 * jitter)


def boundary_hashes(content: Column, block: int = 1 << 20) -> tuple[Column, Column]:
    first = F.sha2(F.substring(content, 1, block), 256)
    last = F.when(F.octet_length(content) <= block, first).otherwise(F.sha2(F.substring(content, -block, block), 256))
    return first, last


def combined_signature(first: Column, last: Column) -> Column:
    return F.sha2(F.concat(F.unhex(first), F.unhex(last)), 256)


def hmac_sha256(secret: str, body: Column) -> Column:
    """Hex HMAC of a text, by two nested digests over the key's padded halves."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def hash_share(text: Column) -> Column:
    """A number in [0, 1) that a text alone decides, as jitter that no layout of the data changes."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


@F.pandas_udf(T.StringType())
def normalize_path(path: pd.Series) -> pd.Series:
    """Trimmed, with ``.`` and ``..`` resolved."""
    return path.map(lambda p: None if p is None else posixpath.normpath(p.strip()) if p.strip() else "")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def job_number(text: Column) -> Column:
    return F.regexp_extract(text, "^job-(\\d+)", 1).try_cast("bigint")


def is_crash(message: Column) -> Column:
    return F.coalesce(message.rlike("segmentation fault|core dumped|SIGSEGV"), F.lit(False))


def event_color(event_type: Column) -> Column:
    """Red for failed, yellow for skipped, else green."""
    return F.when(event_type.contains("failed"), 0xE74C3C).when(event_type.contains("skipped"), 0xF1C40F).otherwise(0x2ECC71)


def gotify_priority(event_type: Column) -> Column:
    return F.when(event_type.contains("failed"), 8).otherwise(5)


def first_error_line(message: Column, most: int = 70) -> Column:
    """First line with anything on it; one of over ``most`` characters is cut there, with ``...`` after it.
    No message reads as ``Transcode execution failed``."""
    text = F.when(F.coalesce(message, F.lit("")) == "", "Transcode execution failed").otherwise(message)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    line = F.coalesce(F.get(lines, F.lit(0)), text)
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def tail_bytes(text: Column, n: int) -> Column:
    return F.when(F.octet_length(text) <= n, text.cast("binary")).otherwise(F.substring(text.cast("binary"), -n, n))


def can_pause(state: Column) -> Column:
    return state.isin("pending", "leased", "evaluating", "transcoding", "processing")


def can_resume(state: Column) -> Column:
    return state.isin("paused", "failed", "quality_failed", "permanently_failed", "skipped")


def conditions_text(conditions: Column) -> Column:
    parts = F.transform(F.array_sort(F.map_entries(conditions)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(conditions), F.lit(0)) > 0, F.array_join(parts, ", ")).otherwise("All files")


def dotted_extensions(text: Column) -> Column:
    return F.transform(split_comma(text), lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))


#: Titles of the event feed.
EVENT_TITLES = {"job_completed": "Completed", "job_failed": "Failed", "job_skipped_growth": "Skipped", "crash_recovery": "Recovery", "startup_recovery": "Recovery"}


def event_title(event_type: Column) -> Column:
    """Title in the event feed; other types go by their own name."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_TITLES.items() for x in kv])[event_type], event_type)


def track_count(tracks: Column) -> Column:
    """How job metadata states its tracks: ``N tracks``."""
    return F.concat(F.coalesce(F.size(tracks), F.lit(0)).cast("string"), F.lit(" tracks"))
