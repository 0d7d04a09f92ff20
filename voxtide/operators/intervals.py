"""Interval sequences: validity, overlap, best match and detection metrics.

Interval tables have ``file_id, idx, start_sample, end_sample`` (half-open, in samples).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.scalars import overlap_length, safe_percent
from voxtide.functions.timecode import int_div
from voxtide.operators.ordered import BLOCK, block_of, blocked_by, previous_row, running_sum
from voxtide.options import SAMPLE_RATE

# Width of the overlap-join buckets: thirty seconds, a few intervals each.
BUCKET = 480_000


def check_sequence(intervals: DataFrame, totals: DataFrame | None = None, block_size: int | None = None) -> DataFrame:
    """Violations of an interval list taken in list order: out of bounds, empty, or starting before the last end.

    ``totals(file_id, total_samples)`` gives the timeline lengths; without it there is no upper bound.
    """
    rows, block = blocked_by(intervals, ["file_id"], block_of(F.col("idx"), block_size or BLOCK), force=bool(block_size))
    rows = previous_row(rows, ["file_id"], block, ["idx"], ["end_sample"], "_prev")
    out_of_bounds = (F.col("start_sample") < 0) | (F.col("end_sample") <= F.col("start_sample"))
    if totals is not None:
        rows = rows.join(totals, "file_id", "left")
        out_of_bounds = out_of_bounds | F.coalesce(F.col("end_sample") > F.col("total_samples"), F.lit(True))
    rule = F.when(out_of_bounds, F.lit("bounds")).when(F.col("start_sample") < F.col("_prev.end_sample"), F.lit("order"))
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("file_id", "idx", "rule")


def _bucketed(intervals: DataFrame, prefix: str, width: int, extra: list[str]) -> DataFrame:
    first, last = int_div(F.col("start_sample"), width), int_div(F.col("end_sample") - 1, width)
    return intervals.select(
        "file_id",
        F.explode(F.sequence(first, last)).alias("_bucket"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("idx", "start_sample", "end_sample", *extra)],
    )


def overlap_pairs(
    a: DataFrame, b: DataFrame, width: int = BUCKET, a_extra: list[str] | None = None, b_extra: list[str] | None = None
) -> DataFrame:
    """Pairs ``a_* / b_*`` of one file that share at least one sample, each pair once.

    Both sides are spread over fixed-width time buckets, so that the join key is (file, bucket): a very long recording
    is divided like many short ones. A pair that meets in several buckets counts only where its overlap begins.
    Empty and negative intervals take no part.
    """
    valid = (F.col("start_sample") >= 0) & (F.col("end_sample") > F.col("start_sample"))
    left = _bucketed(a.filter(valid), "a", width, a_extra or [])
    right = _bucketed(b.filter(valid), "b", width, b_extra or [])
    meet = (F.col("a_start_sample") < F.col("b_end_sample")) & (F.col("a_end_sample") > F.col("b_start_sample"))
    begins_here = int_div(F.greatest("a_start_sample", "b_start_sample"), width) == F.col("_bucket")
    return left.join(right, ["file_id", "_bucket"]).filter(meet & begins_here).drop("_bucket")


def without_overlap(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """Rows of ``a`` that no interval of ``b`` overlaps."""
    met = overlap_pairs(a, b, width).select("file_id", F.col("a_idx").alias("idx")).distinct()
    return a.join(met, ["file_id", "idx"], "left_anti")


def best_matches(expected: DataFrame, detected: DataFrame, tolerance_ms: int = 250, width: int = BUCKET) -> DataFrame:
    """Each expected interval with the detected one it shares most samples with.

    Ties go to the earlier start, then the earlier end; an expected interval without any overlap keeps nulls. Errors
    are detected minus expected; ``shared_samples`` counts the overlap with all detected intervals together.
    """
    overlap = overlap_length(*[F.col(c) for c in ("a_start_sample", "a_end_sample", "b_start_sample", "b_end_sample")])
    ranked = F.struct(
        overlap.alias("overlap"),
        (-F.col("b_start_sample")).alias("s"),
        (-F.col("b_end_sample")).alias("e"),
    )
    best = (
        overlap_pairs(expected, detected, width)
        .groupBy("file_id", F.col("a_idx").alias("idx"))
        .agg(F.max(ranked).alias("_best"), F.sum(overlap).alias("_shared"))
    )
    rows = expected.select("file_id", "idx", "start_sample", "end_sample").join(best, ["file_id", "idx"], "left")
    start_error = -F.col("_best.s") - F.col("start_sample")
    end_error = -F.col("_best.e") - F.col("end_sample")
    tolerance = tolerance_ms * SAMPLE_RATE // 1_000
    within = (F.abs(start_error) <= tolerance) & (F.abs(end_error) <= tolerance)
    return rows.select(
        "file_id",
        "idx",
        "start_sample",
        "end_sample",
        (-F.col("_best.s")).alias("detected_start"),
        (-F.col("_best.e")).alias("detected_end"),
        F.coalesce("_best.overlap", F.lit(0)).alias("overlap_samples"),
        F.coalesce("_shared", F.lit(0)).alias("shared_samples"),
        start_error.alias("start_error"),
        end_error.alias("end_error"),
        F.abs(start_error).alias("abs_start_error"),
        F.abs(end_error).alias("abs_end_error"),
        F.coalesce(within, F.lit(False)).alias("within_tolerance"),
    )


def total_length(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("file_id").agg(F.sum(F.col("end_sample") - F.col("start_sample")).alias("total_samples"))


def overlap_samples(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """Samples per file that two non-overlapping sequences share."""
    shared = overlap_length(*[F.col(c) for c in ("a_start_sample", "a_end_sample", "b_start_sample", "b_end_sample")])
    return overlap_pairs(a, b, width).groupBy("file_id").agg(F.sum(shared).alias("overlap_samples"))


def exact_median(value: Column) -> Column:
    """Middle value, or the mean of the two middle ones; null without values.

    Its state counts distinct values. Boundary errors of overlapping intervals are whole samples no larger than an
    interval, so the maximum segment length bounds it whatever the number of rows.
    """
    return F.percentile(value, 0.5)


def _sums(rows: DataFrame) -> list[Column]:
    counts = (
        "expected_count",
        "matched_count",
        "detected_count",
        "at_max_count",
        "expected_samples",
        "detected_samples",
        "true_positive_samples",
        "within_tolerance_count",
    )
    return [F.sum(c).alias(c) for c in counts] + [
        exact_median(F.col("abs_start_error")).alias("median_abs_start_error"),
        exact_median(F.col("abs_end_error")).alias("median_abs_end_error"),
    ]


def _finish(sums: DataFrame) -> DataFrame:
    missed = F.col("expected_samples") - F.col("true_positive_samples")
    false_positive = F.col("detected_samples") - F.col("true_positive_samples")
    return sums.select(
        "*",
        (F.col("expected_count") - F.col("matched_count")).alias("unmatched_count"),
        missed.alias("missed_samples"),
        false_positive.alias("false_positive_samples"),
        safe_percent(missed, F.col("expected_samples")).alias("missed_percent"),
        safe_percent(false_positive, F.col("detected_samples")).alias("false_positive_percent_of_detected"),
        safe_percent(false_positive, F.col("expected_samples")).alias("false_positive_percent_of_expected"),
        safe_percent(F.col("matched_count"), F.col("expected_count")).alias("recall_percent"),
    )


def detection_metrics(
    expected: DataFrame,
    detected: DataFrame,
    tolerance_ms: int = 250,
    max_segment: int = 400_000,
    roll_up: bool = False,
    width: int = BUCKET,
) -> DataFrame:
    """Detection quality per file; ``roll_up`` adds the corpus row (null file).

    Corpus percentages come from the sums and corpus medians from all matches together. Matches and detected lengths
    are stacked as rows of one shape, so that one join and one aggregation serve all figures.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

    def shape(df: DataFrame, **values: Column) -> DataFrame:
        names = (
            "expected_count matched_count detected_count at_max_count expected_samples detected_samples "
            "true_positive_samples within_tolerance_count"
        ).split()
        return df.select(
            "file_id",
            *[values.get(n, zero).cast("bigint").alias(n) for n in names],
            *[values.get(n, none).alias(n) for n in ("abs_start_error", "abs_end_error")],
        )

    length = F.col("end_sample") - F.col("start_sample")
    matches = best_matches(expected, detected, tolerance_ms, width)
    matched = shape(
        matches,
        expected_count=F.lit(1),
        matched_count=F.col("detected_start").isNotNull(),
        expected_samples=length,
        true_positive_samples=F.col("shared_samples"),
        within_tolerance_count=F.col("within_tolerance"),
        abs_start_error=F.col("abs_start_error"),
        abs_end_error=F.col("abs_end_error"),
    )
    found = shape(detected, detected_count=F.lit(1), detected_samples=length, at_max_count=length == max_segment)
    rows = matched.unionByName(found)
    grouped = rows.rollup("file_id") if roll_up else rows.groupBy("file_id")
    return _finish(grouped.agg(*_sums(rows)))


def corpus_metrics(
    expected: DataFrame, detected: DataFrame, tolerance_ms: int = 250, max_segment: int = 400_000, width: int = BUCKET
) -> DataFrame:
    """The corpus row alone."""
    per_file = detection_metrics(expected, detected, tolerance_ms, max_segment, True, width)
    return per_file.filter("file_id IS NULL").drop("file_id")


def sequences_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per file, whether two interval lists agree position by position; joins row to row, so no list is gathered."""
    keys = ["file_id", "idx"]
    left = a.select(*keys, F.struct("start_sample", "end_sample").alias("_a"))
    right = b.select(*keys, F.struct("start_sample", "end_sample").alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return (
        left.join(right, keys, "full")
        .groupBy("file_id")
        .agg(F.bool_and(same).alias("equal"), F.count("_a").alias("a_count"), F.count("_b").alias("b_count"))
    )


def chunk_intervals(intervals: DataFrame, chunk: int = 1_600) -> DataFrame:
    """Fixed-length pieces of each interval, the last one shorter."""
    starts = F.sequence(F.col("start_sample"), F.col("end_sample") - 1, F.lit(chunk).cast("bigint"))
    pieces = intervals.filter(F.col("end_sample") > F.col("start_sample")).select(
        "file_id", "idx", "end_sample", F.posexplode(starts).alias("chunk_idx", "chunk_start")
    )
    return pieces.select(
        "file_id", "idx", "chunk_idx", "chunk_start", F.least(F.col("chunk_start") + chunk, F.col("end_sample")).alias("chunk_end")
    )


def stage_timeline(intervals: DataFrame, block_size: int | None = None) -> DataFrame:
    """File progress before and after recognising each interval: 0.45 to 0.95 by share of speech samples."""
    rows = intervals.withColumn("_len", F.col("end_sample") - F.col("start_sample"))
    rows, block = blocked_by(rows, ["file_id"], block_of(F.col("idx"), block_size or BLOCK), force=bool(block_size))
    done = running_sum(rows, ["file_id"], block, ["idx"], F.col("_len"), "_done")
    totals = total_length(intervals)
    share = lambda n: F.lit(0.45) + F.lit(0.50) * n / F.col("total_samples")
    return done.join(totals, "file_id").select(
        "file_id",
        "idx",
        share(F.col("_done") - F.col("_len")).alias("progress_before"),
        share(F.col("_done")).alias("progress_after"),
    )
