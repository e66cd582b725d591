"""Layered configuration: defaults, then a YAML or JSON text, then environment variables."""

from __future__ import annotations

import copy
import json
import os
import posixpath
import re
from collections.abc import Mapping
from typing import Any

from framewright.operators.evaluate import AudioPolicy, Rule

#: The defaults by section. Durations are in seconds; paths are below ``home``.
DEFAULTS: dict[str, Any] = {
    "database": {"path": "library.db", "busy_timeout": 5000},
    "filesystem": {
        "scan_interval": 20,
        "scopes": [{"path": "Videos", "extensions": [".mp4", ".mkv", ".mov", ".avi", ".m4v", ".webm"], "exclusions": ["*.part", "*.temp", "*tmp*"], "max_depth": 10, "follow_symlinks": False}],
        "ingestion_capacity": 5000,
    },
    "evaluation": {
        "default_action": "transcode",
        "default_preset": "balanced-hevc",
        "codec_aliases": {"h264": "h264", "avc1": "h264", "hevc": "hevc", "h265": "hevc", "hev1": "hevc", "vp9": "vp9", "av01": "av1", "av1": "av1"},
        "audio_preservation": {"retain_surround_tracks": True, "preferred_languages": ["eng", "ita", "und"], "copy_lossless_audio": True},
        "rules": [
            {"name": "Skip Modern HEVC & AV1", "priority": 100, "conditions": {"codec": "hevc,av1"}, "action": "skip"},
            {"name": "Transcode H.264 High Bitrate to HEVC", "priority": 50, "conditions": {"codec": "h264"}, "action": "transcode", "preset": "balanced-hevc", "audio_action": "copy", "retain_subtitles": True},
        ],
    },
    "transcoder": {
        "hardware_acceleration": "auto", "staging_dir": "staging", "vmaf_enabled": True, "vmaf_threshold": 93.0, "vmaf_sample_count": 3, "vmaf_sample_duration": 30,
        "pre_check_enabled": False, "skip_if_larger": True, "overwrite_source": True, "output_dir": "", "output_suffix": "_transcoded", "max_job_duration": 14400,
        "presets": [
            {"name": "balanced-hevc", "video_codec": "hevc", "quality_crf": 22, "preset_speed": "medium", "audio_codec": "copy", "audio_bitrate": "192k", "extra_ffmpeg": ""},
            {"name": "efficient-av1", "video_codec": "av1", "quality_crf": 26, "preset_speed": "preset=6", "audio_codec": "opus", "audio_bitrate": "128k", "extra_ffmpeg": ""},
        ],
    },
    "concurrency": {"worker_count": 4, "gpu_semaphore_limit": 2, "cpu_semaphore_limit": 4, "prefetch_buffer_depth": 50, "drain_timeout": 300, "retry_max_attempts": 3, "retry_base_interval": 15},
    "notification": {"enabled": False, "batch_window": 30, "batch_max_size": 10, "rate_limit_per_minute": 30, "channels": []},
    "observability": {"log_level": "info", "metrics_port": 9090, "log_json": True, "api_key": ""},
    "scheduling": {"enabled": False, "scan_window": [], "preferred_encoder": ""},
}
#: Settings that hold a duration.
DURATIONS = {("filesystem", "scan_interval"), ("transcoder", "max_job_duration"), ("concurrency", "drain_timeout"), ("concurrency", "retry_base_interval"), ("notification", "batch_window")}
SECRETS = ("api_key", "token", "secret", "password")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def duration(text: str | float) -> float:
    """Seconds of a number or of a text like ``1h30m`` or ``1.5s``; ValueError for any other."""
    if isinstance(text, (int, float)):
        return float(text)
    body, sign = text.strip(), 1.0
    if body[:1] in ("+", "-"):
        body, sign = body[1:], -1.0 if body[0] == "-" else 1.0
    if body == "0":
        return 0.0
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"no duration: {text!r}")
    return sign * sum(float(n) * _UNITS[u] for n, u in parts)


def _positive(text: str) -> int:
    if int(text) <= 0:
        raise ValueError(text)
    return int(text)


def _not_negative(text: str) -> float:
    if duration(text) < 0:
        raise ValueError(text)
    return duration(text)


#: The settings that variables override, after a prefix and an underscore, and how a value is read; one that
#: cannot be read changes nothing.
ENVIRONMENT = {
    "DB_PATH": ("database", "path", str),
    "WORKERS": ("concurrency", "worker_count", _positive),
    "GPU_LIMIT": ("concurrency", "gpu_semaphore_limit", _positive),
    "LOG_LEVEL": ("observability", "log_level", str),
    "METRICS_PORT": ("observability", "metrics_port", _positive),
    "HWACCEL": ("transcoder", "hardware_acceleration", str.lower),
    "SCAN_INTERVAL": ("filesystem", "scan_interval", _not_negative),
}


def _merged(base: dict, over: Mapping) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def _clean(path: str, home: str) -> str:
    """Trimmed, with ``.`` and ``..`` resolved; a relative default lies below ``home``."""
    return posixpath.normpath(posixpath.join(home, path.strip())) if path.strip() else ""


def load(text: str = "", env: Mapping[str, str] | None = None, prefix: str = "FRAMEWRIGHT", home: str = "/") -> dict[str, Any]:
    """Settings of a YAML (where the parser is installed) or JSON text over the defaults, then the environment.

    Mappings merge key by key, lists are replaced. A scan interval of 0 or less counts as 20 seconds.
    """
    given: Any = {}
    if text.strip():
        try:
            given = json.loads(text)
        except ValueError:
            import yaml  # only needed for YAML

            given = yaml.safe_load(text) or {}
    out = _merged(DEFAULTS, given)
    for section, key in DURATIONS:
        out[section][key] = duration(out[section][key])
    for name, (section, key, read) in ENVIRONMENT.items():
        value = (os.environ if env is None else env).get(f"{prefix}_{name}")
        if value:
            try:
                out[section][key] = read(value)
            except ValueError:
                continue
    if out["filesystem"]["scan_interval"] <= 0:
        out["filesystem"]["scan_interval"] = 20.0
    out["database"]["path"] = _clean(out["database"]["path"], home)
    for key in ("staging_dir", "output_dir"):
        out["transcoder"][key] = _clean(out["transcoder"][key], home)
    for scope in out["filesystem"]["scopes"]:
        scope["path"] = _clean(scope.get("path", ""), home)
    return out


def rules(config: Mapping[str, Any]) -> list[Rule]:
    """The rules as the evaluation takes them; what a rule leaves out is empty, and subtitles then go."""
    names = ("name", "priority", "conditions", "action", "preset", "audio_action", "retain_subtitles")
    empty = {"name": "", "priority": 0, "conditions": {}, "action": "", "preset": "", "audio_action": "", "retain_subtitles": False}
    return [Rule(**{k: r.get(k, empty[k]) for k in names}) for r in config["evaluation"]["rules"]]


def audio_policy(config: Mapping[str, Any]) -> AudioPolicy:
    a = config["evaluation"]["audio_preservation"]
    return AudioPolicy(tuple(a["preferred_languages"]), a["copy_lossless_audio"], a["retain_surround_tracks"])


def redacted(config: Mapping[str, Any]) -> dict[str, Any]:
    """A deep copy with every secret replaced; the settings in use are left alone."""

    def clean(v: Any, key: str = "") -> Any:
        if isinstance(v, Mapping):
            return {k: clean(x, k) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x) for x in v]
        return "***REDACTED***" if key in SECRETS and v else v

    return clean(config)
