"""Probe document -> normalized metadata -> first matching rule -> stream plan, without a shuffle.

All of it is one chain of projections over nested columns: streams stay arrays and are never exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import scalar as S
from framewright.schemas import PROBE, STREAMS


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int = 50
    conditions: Mapping[str, str] = field(default_factory=dict)
    action: str = ""
    preset: str = ""
    audio_action: str = "copy"
    retain_subtitles: bool = True


@dataclass(frozen=True)
class AudioPolicy:
    preferred_languages: Sequence[str] = ()
    copy_lossless: bool = True
    retain_surround: bool = True


#: Spellings of a true flag in rules.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")


def parse_bool(text: str) -> bool:
    return text in TRUE_WORDS


def read_probe_json(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Adds ``probe``; unknown fields are dropped, a document that isn't JSON gives null."""
    return df.withColumn("probe", F.from_json(F.col(json_col), PROBE))


def alias_codec(codec: Column, aliases: Mapping[str, str]) -> Column:
    """The alias' codec, else the lower-cased name itself."""
    low = F.lower(codec)
    if not aliases:
        return low
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), low)


def normalize(df: DataFrame, aliases: Mapping[str, str] | None = None, probe_col: str = "probe", path_col: str = "file_path") -> DataFrame:
    """Adds ``metadata``. Numbers that are missing or wrong are 0, not null."""
    p = F.col(probe_col)
    streams = F.coalesce(p["streams"], F.array().cast(STREAMS))
    of_kind = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    pictures = F.filter(of_kind("video"), lambda s: S.is_attached_picture(s["codec_name"]))
    films = F.filter(of_kind("video"), lambda s: ~S.is_attached_picture(s["codec_name"]))
    named = F.filter(films, lambda s: F.coalesce(s["codec_name"], F.lit("")) != "")
    video = F.coalesce(F.get(named, F.lit(0)), F.get(films, F.lit(0)))
    tag = lambda s, k: F.coalesce(s["tags"][k], F.lit(""))
    flag = lambda s, k: F.coalesce(s["disposition"][k], F.lit(0)) == 1
    audio = F.transform(
        of_kind("audio"),
        lambda s: F.struct(
            s["index"].alias("index"), F.lower(s["codec_name"]).alias("codec"), F.coalesce(s["channels"], F.lit(0)).alias("channels"),
            s["channel_layout"].alias("layout"), S.parse_bitrate(F.coalesce(s["bit_rate"], F.lit(""))).alias("bitrate"),
            F.lower(tag(s, "language")).alias("language"), tag(s, "title").alias("title"), flag(s, "default").alias("is_default"),
            (F.coalesce(s["channels"], F.lit(0)) >= 6).alias("is_surround"), S.is_lossless_audio(s["codec_name"]).alias("is_lossless"),
        ),
    )
    subtitles = F.transform(
        of_kind("subtitle"),
        lambda s: F.struct(
            s["index"].alias("index"), F.lower(s["codec_name"]).alias("codec"), F.lower(tag(s, "language")).alias("language"),
            tag(s, "title").alias("title"), flag(s, "default").alias("is_default"), flag(s, "forced").alias("is_forced"),
        ),
    )
    pix = F.coalesce(video["pix_fmt"], F.lit(""))
    meta = F.struct(
        alias_codec(F.coalesce(video["codec_name"], F.lit("")), aliases or {}).alias("video_codec"),
        F.coalesce(video["width"], F.lit(0)).alias("width"),
        F.coalesce(video["height"], F.lit(0)).alias("height"),
        S.resolution_tag(video["width"], video["height"]).alias("resolution"),
        pix.alias("pix_fmt"),
        S.bit_depth(pix).alias("bit_depth"),
        S.chroma(pix).alias("chroma"),
        S.hdr_kind(video["color_transfer"], video["color_primaries"], video["side_data_list"]).alias("hdr"),
        S.parse_bitrate(F.coalesce(p["format"]["bit_rate"], F.lit(""))).alias("bitrate"),
        S.parse_float(F.coalesce(p["format"]["duration"], F.lit(""))).alias("duration"),
        S.parse_bitrate(F.coalesce(p["format"]["size"], F.lit(""))).alias("file_size"),
        F.coalesce(p["format"]["format_name"], F.lit("")).alias("container"),
        audio.alias("audio"),
        subtitles.alias("subtitles"),
        F.transform(pictures, lambda s: s["index"]).alias("pictures"),
        F.coalesce(F.size(p["chapters"]), F.lit(0)).alias("chapters"),
    )
    out = df.withColumn("metadata", meta)
    m = F.col("metadata")
    return out.withColumn(
        "metadata",
        m.withField("is_hdr", m["hdr"] != "none")
        .withField("has_surround", F.exists(m["audio"], lambda a: a["is_surround"]))
        .withField("has_lossless", F.exists(m["audio"], lambda a: a["is_lossless"])),
    )


def split_list(text: str) -> list[str]:
    return [x for x in (p.strip().lower() for p in text.split(",")) if x]


def condition(key: str, value: str, field_of: Callable[[str], Column]) -> Column:
    """One condition as a column; keys without a meaning match everything, an empty list nothing."""
    key = key.lower()
    if key in ("codec", "resolution"):
        wanted = split_list(value)
        name = "video_codec" if key == "codec" else "resolution"
        return F.coalesce(F.lower(field_of(name)).isin(wanted), F.lit(False)) if wanted else F.lit(False)
    if key in ("is_hdr", "has_surround"):
        return field_of(key) == F.lit(parse_bool(value.strip()))
    if key == "min_bitrate":
        text = value.strip()
        return field_of("bitrate") >= F.lit(int(text) if text.lstrip("+-").isdigit() else 0)
    return F.lit(True)


def decide(
    df: DataFrame, rules: Sequence[Rule], default_action: str = "skip", default_preset: str = "", field_of: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Adds ``decision``: of the rules by falling priority (then as listed) the first whose conditions
    all hold. The rules are one CASE expression: no join, whatever their number."""
    get = field_of or (lambda name: F.col("metadata")[name])
    struct = lambda rule, action, preset, audio, keep: F.struct(F.lit(rule).alias("matched_rule"), F.lit(action).alias("action"), F.lit(preset).alias("preset"), F.lit(audio).alias("audio_action"), F.lit(keep).alias("retain_subtitles"))
    case = None
    for r in sorted(rules, key=lambda r: -r.priority):
        holds = reduce(lambda a, b: a & b, (condition(k, v, get) for k, v in r.conditions.items()), F.lit(True))
        action = r.action or default_action
        preset = r.preset or (default_preset if action == "transcode" else "")
        made = struct(r.name, action, preset, r.audio_action, r.retain_subtitles)
        case = F.when(holds, made) if case is None else case.when(holds, made)
    last = struct("default", default_action, default_preset, "copy", True)
    return df.withColumn("decision", last if case is None else case.otherwise(last))


#: The most cells of a decision table (codecs by resolutions by two flags), which is broadcast.
MOST_CELLS = 1_000_000
#: A value that no rule names, and one that is missing.
OTHER_VALUE, NO_VALUE = "\x00other", "\x00none"


def decision_table(rules: Sequence[Mapping]) -> tuple[list[tuple], set[str], set[str]]:
    """(cells, codecs, resolutions) of rules given as rows. A cell is (codec, resolution, is_hdr, has_surround, steps): the rules
    that can come first there, as (least bitrate, rule's name) from the first on, each with a lower bound than the one before.

    A rule that asks for a bitrate which an earlier one undercuts never comes first, so steps are few: as a rule one or two,
    however many rules there are.
    """
    order = sorted(rules, key=lambda r: (-r["priority"], r["ord"]))
    lowest = np.array([-(2**63) if r["min_bitrate"] is None else r["min_bitrate"] for r in order], np.int64)
    codecs = sorted({c for r in order for c in r["codecs"] or ()})
    sizes = sorted({c for r in order for c in r["resolutions"] or ()})

    def holds(name: str, values: Sequence) -> dict:
        return {v: np.array([r[name] is None or v in (r[name] if isinstance(r[name], (list, tuple)) else (r[name],)) for r in order], bool) for v in values}

    by_codec, by_size = holds("codecs", [*codecs, OTHER_VALUE, NO_VALUE]), holds("resolutions", [*sizes, OTHER_VALUE, NO_VALUE])
    flags = [holds(name, [True, False, NO_VALUE]) for name in ("is_hdr", "has_surround")]
    if len(by_codec) * len(by_size) * 9 > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} cells: compile such rules with decide()")
    cells = []
    for (codec, a), (size, b) in product(by_codec.items(), by_size.items()):
        for (hdr, c), (surround, d) in product(*(f.items() for f in flags)):
            at = np.flatnonzero(a & b & c & d)
            bounds = lowest[at]
            first = np.ones(len(at), bool)
            first[1:] = bounds[1:] < np.minimum.accumulate(bounds)[:-1]
            steps = [(None if lowest[i] == -(2**63) else int(lowest[i]), order[i]["name"]) for i in at[first]]
            cells.append((codec, size, str(hdr), str(surround), steps))
    return cells, set(codecs), set(sizes)


def decide_by_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` and ``matched_rule`` for rules in a table (name, priority, ord, codecs, resolutions, is_hdr, has_surround, min_bitrate;
    null: no condition), ``default`` where none matches.

    Rules are configuration, up to 10,000 of them, compiled into a ``decision_table``: a row finds its cell by a broadcast hash join
    and its rule among the cell's few steps, so rows neither shuffle nor meet the rules one by one. A condition on a value that a row
    lacks doesn't hold.
    """
    got = [r.asDict() for r in rules.limit(10_001).collect()]
    if len(got) > 10_000:
        raise ValueError("more than 10,000 rules: compile them with decide()")
    cells, codecs, sizes = decision_table(got)
    table = df.sparkSession.createDataFrame(cells, "_codec string, _size string, _hdr string, _surround string, _steps array<struct<least: bigint, name: string>>")
    m = F.col("metadata")

    def cell(value: Column, known: set[str]) -> Column:
        return F.when(value.isNull(), NO_VALUE).when(value.isin(*known), value).otherwise(OTHER_VALUE) if known else F.when(value.isNull(), NO_VALUE).otherwise(OTHER_VALUE)

    flag = lambda v: F.when(v.isNull(), NO_VALUE).when(v, "True").otherwise("False")
    keyed = df.withColumns({"_codec": cell(m["video_codec"], codecs), "_size": cell(m["resolution"], sizes), "_hdr": flag(m["is_hdr"]), "_surround": flag(m["has_surround"])})
    joined = keyed.join(F.broadcast(table), ["_codec", "_size", "_hdr", "_surround"], "left")
    hit = F.filter("_steps", lambda s: s["least"].isNull() | (m["bitrate"] >= s["least"]))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.get(hit, F.lit(0))["name"], F.lit("default")).alias("matched_rule"))


def stream_plan(df: DataFrame, policy: AudioPolicy = AudioPolicy()) -> DataFrame:
    """Adds ``plan``: map arguments, audio and subtitle arguments, and a summary."""
    m, d = F.col("metadata"), F.col("decision")
    preferred = [x.lower() for x in policy.preferred_languages]
    kept = m["audio"]
    if preferred:
        kept = F.filter(kept, lambda a: a["language"].isin(preferred) | (a["language"] == "") | a["is_default"])
    texts = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    retain = d["retain_subtitles"] & (F.size(m["subtitles"]) > 0)
    none = F.array().cast("array<string>")
    maps = F.concat(
        texts("-map", "0:v:0"),
        F.flatten(F.transform(m["pictures"], lambda i: texts("-map", F.concat(F.lit("-0:v:"), i.cast("string"))))),
        F.flatten(F.transform(kept, lambda a: texts("-map", F.concat(F.lit("0:"), a["index"].cast("string"))))),
        F.when(retain, texts("-map", "0:s")).otherwise(none),
    )
    copies = lambda a: (d["audio_action"] != "aac_stereo") | (F.lit(policy.copy_lossless) & a["is_lossless"]) | (F.lit(policy.retain_surround) & a["is_surround"])
    number = lambda k, i: F.concat(F.lit(k), i.cast("string"))
    codec = F.flatten(
        F.transform(
            kept,
            lambda a, i: F.when(copies(a), texts(number("-c:a:", i), "copy")).otherwise(
                texts(number("-c:a:", i), "aac", number("-b:a:", i), "192k", number("-ac:", i), "2")
            ),
        )
    )
    # The notes of a plan. A track whose copying is asked for names its layout.
    asked = lambda a: (d["audio_action"] == "copy") | (F.lit(policy.copy_lossless) & a["is_lossless"]) | (F.lit(policy.retain_surround) & a["is_surround"])
    note = lambda a: (
        F.when(asked(a), F.format_string("Audio #%d (%s, %s): copy", a["index"], a["codec"], F.coalesce(a["layout"], F.lit(""))))
        .when(d["audio_action"] == "aac_stereo", F.format_string("Audio #%d (%s): re-encode aac stereo", a["index"], a["codec"]))
        .otherwise(F.format_string("Audio #%d (%s): copy", a["index"], a["codec"]))
    )
    lines = F.concat(
        texts("Video: 0:v:0"),
        F.transform(m["pictures"], lambda i: number("Exclude attached pic: 0:v:", i)),
        F.when(F.size(m["audio"]) == 0, texts("Audio: none")).otherwise(F.transform(kept, note)),
        F.when(retain, texts(F.format_string("Subtitles: %d tracks preserved via copy", F.size(m["subtitles"])))).otherwise(none),
    )
    plan = F.struct(maps.alias("map_args"), codec.alias("audio_codec_args"), F.when(retain, texts("-c:s", "copy")).otherwise(none).alias("subtitle_args"), F.array_join(lines, " | ").alias("summary"))
    return df.withColumn("plan", plan)


def with_presets(df: DataFrame, presets: DataFrame, first: str, preset_col: Column) -> DataFrame:
    """Left join to presets by name, case-insensitively; ``first`` stands in for a name that is missing.
    Presets are configuration: more than 10,000 are refused rather than broadcast."""
    if presets.count() > 10_000:
        raise ValueError("more than 10,000 presets")
    named = presets.select(F.lower("name").alias("_preset"), F.col("name").alias("preset_name"))
    return df.join(F.broadcast(named), F.lower(preset_col) == F.col("_preset"), "left").drop("_preset").withColumn("preset_name", F.coalesce("preset_name", F.lit(first)))


@dataclass(frozen=True)
class Preset:
    """Encoder settings by name."""

    name: str
    video_codec: str = ""
    quality_crf: int = 0
    preset_speed: str = ""
    audio_codec: str = ""


#: The preset where none is configured.
BUILT_IN = Preset("balanced-hevc", "hevc", 22, "medium", "copy")


def select_preset(df: DataFrame, presets: Sequence[Preset], preset_col: Column) -> DataFrame:
    """Adds ``preset``, a struct: the first configured one of that name, whatever its case; else the first configured; else the
    built-in one. Presets are configuration, a literal map."""
    struct = lambda p: F.struct(*[F.lit(v).alias(k) for k, v in p.__dict__.items()])
    named: dict[str, Preset] = {}
    for p in presets:
        named.setdefault(p.name.lower(), p)
    last = struct(presets[0] if presets else BUILT_IN)
    if not named:
        return df.withColumn("preset", last)
    table = F.create_map(*[x for k, p in named.items() for x in (F.lit(k), struct(p))])
    return df.withColumn("preset", F.coalesce(F.try_element_at(table, F.lower(preset_col)), last))


#: Hardware families in order of preference, what each calls a codec it knows, and what it
#: tries, in order, for that codec.
FAMILIES = ("nvenc", "qsv", "amf", "vaapi")
CODEC_NAMES = {"hevc": "hevc", "h265": "hevc", "h264": "h264", "avc": "h264", "av1": "av1"}
UNKNOWN_TO = {"amf": ("avc", "av1")}
STEPS_DOWN = {"vaapi": {"hevc": ("hevc", "h264"), "av1": ("av1", "hevc", "h264")}}


def select_encoder(codec: Column, prefer: Column, encoders: Column, families: Column | None = None) -> Column:
    """Struct (encoder, hardware) by target codec, preferred family (or ``auto``; ``cpu`` and ``none`` for
    software) and the map of working encoders. ``families`` is a map of families whose hardware is there;
    unless given, a family with any working encoder is. Where no family has one, software stands in:
    libx265 for HEVC, libsvtav1 (or libaom-av1) for AV1, libx264 for all others."""
    name, wish = F.lower(codec), F.lower(F.coalesce(prefer, F.lit("")))
    has = lambda encoder: F.coalesce(encoders[encoder], F.lit(False))
    pick = lambda encoder, hardware: F.struct(F.lit(encoder).alias("encoder"), F.lit(hardware).alias("hardware"))
    case = F.when(name.isin("hevc", "h265"), pick("libx265", False)).when((name == "av1") & has("libsvtav1"), pick("libsvtav1", False)).when(name == "av1", pick("libaom-av1", False)).otherwise(pick("libx264", False))
    steps = []
    for family in FAMILIES:
        there = F.lit(True) if families is None else F.coalesce(families[family], F.lit(False))
        for alias, known in CODEC_NAMES.items():
            if alias in UNKNOWN_TO.get(family, ()):
                continue
            for tried in STEPS_DOWN.get(family, {}).get(known, (known,)):
                steps.append((wish.isin("auto", family) & there & (name == alias) & has(f"{tried}_{family}"), pick(f"{tried}_{family}", True)))
    for holds, value in reversed(steps):
        case = F.when(holds, value).otherwise(case)
    return case


#: Encoders that count only if a trial run of them worked, by family.
TRIED = {
    "nvenc": ("hevc_nvenc", "h264_nvenc", "av1_nvenc"), "qsv": ("hevc_qsv", "h264_qsv", "av1_qsv"), "amf": ("hevc_amf", "h264_amf"), "vaapi": ("hevc_vaapi", "h264_vaapi"),
}
#: Devices of video acceleration, the first that exists is taken; the last is taken even if it doesn't.
DEVICES = ("/dev/dri/card0", "/dev/dri/renderD128", "/dev/dri")


def working_encoders(listed: Column, tested: Column) -> Column:
    """Map of the encoders that a tool lists: those that are to be tried only if their test passed, others as listed."""
    tried = [e for family in TRIED.values() for e in family]
    good = F.filter(F.array_distinct(listed), lambda e: ~e.isin(*tried) | F.array_contains(tested, e))
    return F.map_from_arrays(good, F.transform(good, lambda e: F.lit(True)))


def hardware_report(encoders: Column) -> Column:
    """Struct of what a machine can do, from its map of working encoders: a flag for each family, and the encoders by name."""
    has = lambda e: F.coalesce(F.try_element_at(encoders, F.lit(e)), F.lit(False))
    flags = [reduce(lambda a, b: a | b, map(has, names)).alias(f"has_{family}") for family, names in TRIED.items()]
    return F.struct(*flags, F.array_sort(F.map_keys(encoders)).alias("encoders"))


def acceleration_device(existing: Sequence[str]) -> str:
    return next((d for d in DEVICES if d in existing), DEVICES[-1])


def encoder_arguments(
    encoder: Column, hardware: Column, source: Column, target: Column, crf: Column, speed: Column, plan: Column, device: str = DEVICES[0],
) -> Column:
    """The encoder's argument vector as an array of text: input resilience, stream maps, video encoder with
    its family's quality settings, audio and subtitles of ``plan``, muxing and container."""
    none = F.array().cast("array<string>")
    texts = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    q = F.when(F.coalesce(crf, F.lit(0)) <= 0, 22).otherwise(crf).cast("string")
    pace = F.when(F.coalesce(speed, F.lit("")) == "", "medium").otherwise(speed)
    vaapi = hardware & encoder.contains("vaapi")
    given = lambda part, default: F.when(F.coalesce(F.size(plan[part]), F.lit(0)) > 0, plan[part]).otherwise(default)
    # The options of each family.
    by_family = (
        F.when(encoder.contains("nvenc"), texts("-cq", q, "-preset", "p5", "-spatial-aq", "1", "-temporal-aq", "1"))
        .when(encoder.contains("qsv"), texts("-global_quality", q, "-preset", pace))
        .when(encoder.contains("amf"), texts("-rc", "cqp", "-qp_p", q, "-qp_i", q))
        .otherwise(texts("-crf", q))
    )
    software = F.when(encoder.contains("libsvtav1"), texts("-crf", q, "-preset", "6", "-svtav1-params", "tune=0")).otherwise(
        F.concat(texts("-crf", q, "-preset", pace), F.when(encoder.contains("libx265"), texts("-x265-params", "no-high-tier=1:no-bframes=4:weightp=0")).otherwise(none))
    )
    end = S.extension(target)
    return F.concat(
        texts("-hide_banner", "-y", "-fflags", "+genpts+discardcorrupt", "-err_detect", "ignore_err", "-ignore_unknown", "-thread_queue_size", "1024"),
        F.when(vaapi, texts("-vaapi_device", device)).otherwise(none),
        texts("-i", source),
        given("map_args", texts("-map", "0:v:0", "-map", "0:a", "-map", "0:s")),
        texts("-c:v", encoder),
        F.when(vaapi, texts("-vaapi_device", device, "-vf", "format=nv12,hwupload")).otherwise(texts("-vf", "format=yuv420p")),
        F.when(hardware, by_family).otherwise(software),
        given("audio_codec_args", texts("-c:a", "copy")),
        given("subtitle_args", texts("-c:s", "copy")),
        texts("-max_muxing_queue_size", "4096", "-map_metadata", "-1"),
        F.when(end == ".mkv", texts("-f", "matroska")).when(end == ".mp4", texts("-f", "mp4")).otherwise(none),
        texts(target),
    )
