"""Verdicts over encoder results: sample points, scores, growth, and the outcome of a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions import scalar as S

#: Limits of the structural similarity score, and sample points by their number.
SSIM_LEAST, SSIM_GOOD = 0.90, 0.92
POINTS = {1: (0.5,), 3: (0.15, 0.5, 0.85), 5: (0.1, 0.3, 0.5, 0.7, 0.9)}


def sample_starts(duration: Column, n: Column) -> Column:
    points = lambda k: F.array(*[duration * p for p in POINTS[k]])
    return F.when(n <= 1, points(1)).when(n <= 3, points(3)).otherwise(points(5))


def extract_score(text: Column, name: str) -> Column:
    """The ``ssim`` or ``vmaf`` score in a tool's output; null without one.

    SSIM stands after ``All:``, VMAF after ``VMAF score:`` or, in another log format, as the word after
    ``score:`` on a line that speaks of vmaf.
    """
    if name == "ssim":
        return F.nullif(F.regexp_extract(text, "All:\\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    first = F.nullif(F.regexp_extract(text, "VMAF score:\\s*([0-9.]+)", 1), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("vmaf") & x.contains("score"))
    found = F.transform(lines, lambda x: F.regexp_extract(x, "(?:^|\\s)score:\\s+(\\S+)", 1))
    return F.coalesce(first, F.get(F.filter(found, lambda x: x != ""), F.lit(0))).try_cast("double")


def mean_score(scores: Column) -> Column:
    """Mean of scores above 0; null without any."""
    good = F.filter(scores, lambda s: s > 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, s: a + s) / F.size(good))


def verdict(ssim: Column, mean_vmaf: Column, threshold: float) -> Column:
    """Struct (passed, reason). Without any score of a segment (null mean) the structural similarity decides, and
    where that is unknown too, the file passes."""
    made = lambda ok, *text: F.struct(F.lit(ok).alias("passed"), F.concat(*text).alias("reason"))
    s, v, least = S.fixed(ssim, 4), S.fixed(mean_vmaf, 2), F.lit(f"{threshold:.2f}")
    # The reasons, word by word.
    return (
        F.when((ssim > 0) & (ssim < SSIM_LEAST), made(False, F.lit("SSIM score "), s, F.lit(" failed quality threshold (minimum 0.90)")))
        .when(mean_vmaf < threshold, made(False, F.lit("average VMAF "), v, F.lit(" below configured threshold "), least))
        .when(mean_vmaf.isNotNull(), made(True, F.lit("verified: average VMAF "), v, F.lit(" meets threshold "), least))
        .when(ssim >= SSIM_GOOD, made(True, F.lit("verified via SSIM score "), s, F.lit(" (libvmaf unavailable for segments)")))
        .otherwise(made(True, F.lit("verification completed without fatal error")))
    )


def precheck(vmaf: Column, ssim: Column, threshold: float) -> Column:
    return (vmaf >= threshold) & (ssim >= SSIM_LEAST)


def grew(skip_if_larger: Column, orig: Column, new: Column) -> Column:
    return skip_if_larger & (orig > 0) & (new >= orig)


def outcome(
    path: Column, action: Column, probe_failed: Column, review_reason: Column, precheck_failed: Column, growth: Column,
    quality_ok: Column, error: Column, canceled: Column, retry_count: Column, max_retries: int = 3,
) -> Column:
    """Struct (state, audit, notice) of a job's result; one CASE, first condition that holds."""
    made = lambda s, a, n: F.struct(*(F.lit(x).cast("string").alias(k) for k, x in (("state", s), ("audit", a), ("notice", n))))
    failed = F.coalesce(error, F.lit("")) != ""
    retried = F.when(retry_count < max_retries, made("pending", None, "job_retried")).otherwise(made("permanently_failed", "job_failed", "job_failed"))
    return (
        F.when(F.lower(S.stem(path)).endswith("_crunched"), made("skipped", "job_skipped", "job_skipped"))
        .when(probe_failed, F.when(S.is_crash(error), made("permanently_failed", "job_crash", "job_failed")).otherwise(retried))
        .when(action == "skip", made("skipped", "job_skipped", "job_skipped"))
        .when(action == "review", made("review_required", None, None))
        .when(action == "copy", made("completed", "job_copied", "job_completed"))
        .when(action != "transcode", made("evaluating", None, None))
        .when(review_reason.isNotNull(), made("review_required", "job_pixfmt_review", None))
        .when(canceled, made(None, None, None))
        .when(precheck_failed, made("skipped", "job_skipped_precheck", "job_skipped_precheck"))
        .when(failed & S.is_crash(error), made("permanently_failed", "job_crash", "job_failed"))
        .when(failed, retried)
        .when(growth, made("skipped", "job_skipped_growth", "job_skipped_growth"))
        .when(~quality_ok, made("quality_failed", "job_quality_failed", "job_quality_failed"))
        .otherwise(made("completed", "job_completed", "job_completed"))
    )
