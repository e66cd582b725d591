"""Schemas and fixed vocabularies of the media-library tables."""

from __future__ import annotations

#: The states of a queue entry.
STATES = ("pending", "leased", "evaluating", "transcoding", "processing", "completed", "failed", "quality_failed", "permanently_failed", "skipped", "paused", "review_required")
IN_FLIGHT = ("leased", "processing", "evaluating", "transcoding")
DONE = ("completed", "skipped", "paused")
FAILED = ("failed", "quality_failed", "permanently_failed")


# Schemas are DDL text: readers and parsers take it as it is, and it needs no session.
QUEUE = "id bigint, file_path string, state string, worker_id string, priority int, retry_count int, created_at timestamp, leased_at timestamp, lease_expires_at timestamp, scheduled_at timestamp, error_message string"
JOB_METADATA = "queue_id bigint, video_codec string, resolution string, bitrate bigint, duration double, audio_tracks string, subtitles string, decision_action string, preset string, stream_map_json string, normalized_json string, created_at timestamp"
AUDIT = "seq_id bigint, timestamp timestamp, event_type string, severity string, payload_json string"
DELIVERY = "id bigint, event_id string, channel string, status string, response string, timestamp timestamp"
DEAD_LETTER = "id bigint, event_json string, retry_count int, last_error string, created_at timestamp"
SIGNATURE = "path string, size bigint, first_mb_hash binary, last_mb_hash binary, first_seen timestamp, last_scanned timestamp"
PAYLOAD = "queue_id bigint, orig_size bigint, new_size bigint, saved_bytes bigint, vmaf double, duration double, encoder string, hw boolean, reason string"

STREAM = "index int, codec_name string, codec_long_name string, codec_type string, profile string, width int, height int, r_frame_rate string, avg_frame_rate string, pix_fmt string, color_range string, color_space string, color_transfer string, color_primaries string, bit_rate string, channels int, channel_layout string, sample_rate string, tags map<string,string>, disposition map<string,int>, side_data_list array<map<string,string>>"
FORMAT = "filename string, nb_streams int, format_name string, format_long_name string, duration string, size string, bit_rate string, tags map<string,string>"
CHAPTER = "id int, time_base string, `start` bigint, start_time string, `end` bigint, end_time string, tags map<string,string>"
STREAMS = f"array<struct<{STREAM}>>"
PROBE = f"streams {STREAMS}, format struct<{FORMAT}>, chapters array<struct<{CHAPTER}>>"
