"""Numeric and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtide.options import DetectorOptions

FULL_SCALE = 32_768.0
NEG_INF = float("-inf")


def is_valid_interval(start: Column, end: Column) -> Column:
    return (start >= 0) & (end > start)


def clamp_interval(start: Column, end: Column, total: Column) -> Column:
    """Both ends limited to [0, total]."""
    limit = lambda value: F.least(F.greatest(value, F.lit(0)), total)
    return F.struct(limit(start).alias("start_sample"), limit(end).alias("end_sample"))


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def safe_percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / F.nullif(total, F.lit(0)))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def normalize_progress(value: Column) -> Column:
    """Fraction clamped to [0, 1]; null when the report must be ignored."""
    return F.when(is_finite(value), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


# The share of a file's progress that each stage covers (start, end).
STAGE_SPANS = {
    "ExtractingAudio": (0.0, 0.30),
    "DetectingSpeech": (0.30, 0.45),
    "Transcribing": (0.45, 0.95),
    "WritingVtt": (0.95, 1.0),
}


def stage_progress(stage: Column, fraction: Column) -> Column:
    """File progress from the progress within a stage; other stages give null."""
    bounded = normalize_progress(fraction)
    result = F.lit(None).cast("double")
    for name, (low, high) in STAGE_SPANS.items():
        result = F.when(stage == name, F.lit(low) + F.lit(high - low) * bounded).otherwise(result)
    return result


def dbfs_from_rms(rms: Column) -> Column:
    return F.when(rms > 0, F.lit(20.0) * F.log10(rms / FULL_SCALE)).otherwise(F.lit(NEG_INF))


def thresholds(noise_floor: Column, options: DetectorOptions) -> tuple[Column, Column]:
    on = F.greatest(F.lit(options.min_on), noise_floor + options.on_margin)
    off = F.greatest(F.lit(options.min_off), noise_floor + options.off_margin)
    return on, off


def classify_frame(dbfs: Column, noise_floor: Column, options: DetectorOptions) -> tuple[Column, Column]:
    """(above, below) of a frame against the thresholds in force."""
    on, off = thresholds(noise_floor, options)
    return dbfs >= on, dbfs < off
