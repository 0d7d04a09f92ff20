"""Job events: states, progress, timing and publication.

Events have ``batch_id, job_id, seq, ts, state, stage, progress, detail, cue_count, forced``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxtide.functions.scalars import normalize_progress
from voxtide.operators.folds import blocked_fold
from voxtide.operators.ordered import (
    BLOCK,
    block_of,
    blocked_by,
    local_window,
    row_index,
    running_last,
    running_max,
    settle,
    with_halo,
)

PENDING, TRANSCRIBING = "Pending", "Transcribing"
TERMINAL = ("Complete", "Failed", "Cancelled")
PUBLISH_MS = 75
TIMING_WINDOW = 5
JOB = ["batch_id", "job_id"]


def _blocked(events: DataFrame, keys: list[str], block_size: int | None) -> tuple[DataFrame, str | None]:
    return blocked_by(events, keys, block_of(F.col("seq"), block_size or BLOCK), force=bool(block_size))


def state_rank(state: Column) -> Column:
    """Pending 0, active 1, terminal 2; null for anything else."""
    return F.when(state == PENDING, 0).when(state == TRANSCRIBING, 1).when(state.isin(*TERMINAL), 2)


def illegal_transitions(events: DataFrame, block_size: int | None = None) -> DataFrame:
    """Events that the state machine does not allow: an unknown state, going back, or anything after a terminal state."""
    rows, block = _blocked(events, JOB, block_size)
    rows = running_max(rows, JOB, block, ["seq"], state_rank(F.col("state")), "_reached", inclusive=False)
    rank = state_rank(F.col("state"))
    rule = (
        F.when(rank.isNull(), F.lit("unknown state"))
        .when(F.col("_reached") == 2, F.lit("after terminal"))
        .when(rank < F.col("_reached"), F.lit("backwards"))
    )
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select(*JOB, "seq", "state", "rule")


def current_jobs(events: DataFrame) -> DataFrame:
    """State of each job with illegal events ignored.

    The first terminal event decides; without one a job is active once any event made it so. That needs no order
    beyond minima and maxima, so it is one aggregation with map-side combining.
    """
    terminal = F.col("state").isin(*TERMINAL)
    return events.groupBy(*JOB).agg(
        F.coalesce(
            F.min_by("state", F.when(terminal, F.col("seq"))),
            F.when(F.bool_or(F.col("state") == TRANSCRIBING), F.lit(TRANSCRIBING)).otherwise(F.lit(PENDING)),
        ).alias("state"),
        F.max("seq").alias("last_seq"),
        F.max(normalize_progress(F.col("progress"))).alias("progress"),
    )


def cancel_cascade(jobs: DataFrame, cancels: DataFrame) -> DataFrame:
    """A cancelled batch cancels all its unfinished jobs; finished ones keep their state."""
    hit = cancels.select("batch_id").distinct().withColumn("_cancel", F.lit(True))
    open_job = ~F.col("state").isin(*TERMINAL) & F.coalesce(F.col("_cancel"), F.lit(False))
    return (
        jobs.join(hit, "batch_id", "left")
        .withColumn("state", F.when(open_job, F.lit("Cancelled")).otherwise(F.col("state")))
        .drop("_cancel")
    )


def job_summary(jobs: DataFrame) -> DataFrame:
    """Counts per batch and the kind of closing message."""
    count = lambda s: F.count_if(F.col("state") == s)
    rows = jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        count("Complete").alias("complete"),
        count("Failed").alias("failed"),
        count("Cancelled").alias("cancelled"),
        F.count_if(F.col("state").isin(*TERMINAL)).alias("finished"),
    )
    kind = F.when(F.col("cancelled") > 0, "warning: cancelled").when(F.col("failed") > 0, "warning: failures").otherwise("success")
    return rows.withColumn("message", kind)


def batch_snapshot(events: DataFrame) -> DataFrame:
    """Counters of every batch from the jobs' current states."""
    return job_summary(current_jobs(events))


def first_stage(events: DataFrame, stage: str, keys: list[str] | None = None) -> DataFrame:
    """Where a stage was first seen, per job or other key."""
    at = F.when(F.col("stage") == stage, F.col("seq"))
    return events.groupBy(*(keys or JOB)).agg(F.min(at).alias("first_seq"), F.min_by("ts", at).alias("first_ts"))


def monotone_progress(events: DataFrame, block_size: int | None = None) -> DataFrame:
    """Progress that never falls; reports that are null or not finite leave it where it was."""
    rows, block = _blocked(events, JOB, block_size)
    rows = running_max(rows, JOB, block, ["seq"], normalize_progress(F.col("progress")), "_p")
    return rows.withColumn("shown_progress", F.coalesce("_p", F.lit(0.0))).drop("_p", "_b")


def drop_late_progress(events: DataFrame, block_size: int | None = None) -> DataFrame:
    """Progress reports of the stage in force only; ``forced`` rows are the stage changes."""
    rows, block = _blocked(events, JOB, block_size)
    rows = running_last(rows, JOB, block, ["seq"], F.when(F.col("forced"), F.col("stage")), "_stage")
    return rows.filter("NOT forced AND stage = _stage").drop("_stage", "_b")


def rolling_durations(durations: DataFrame, keys: list[str], block_size: int | None = None, window: int = TIMING_WINDOW) -> DataFrame:
    """Mean of the last positive durations: ``seq, duration_ms, remaining`` plus the mean and the time left."""
    rows, block = _blocked(durations.filter("duration_ms > 0"), keys, block_size)
    if block:
        rows = settle(row_index(rows, keys, block, ["seq"], "_i").drop(block), block)
        rows = with_halo(rows, "_i", block, block_size or BLOCK, window - 1)
    else:
        rows = rows.withColumn("halo", F.lit(False))
    recent = local_window(keys, block, ["seq"]).rowsBetween(1 - window, 0)
    mean = F.floor(F.avg("duration_ms").over(recent)).cast("bigint")
    rows = rows.withColumn("mean_ms", mean).filter("NOT halo").drop("halo", "_i", "_b")
    return rows.withColumn("eta_ms", F.col("mean_ms") * F.greatest("remaining", F.lit(0)))


def throttle(events: DataFrame, interval_ms: int = PUBLISH_MS, block_size: int | None = None) -> DataFrame:
    """Events that are published: forced ones, and those at least the interval after the last published one."""
    interval = interval_ms * 1_000

    def step(rows: dict[str, list], state, last: bool):
        kept = []
        for seq, at, forced in zip(rows["seq"], rows["_at"], rows["forced"]):
            if forced or state is None or at - state >= interval:
                state = at
                kept.append((seq,))
        return kept, state

    rows, block = _blocked(events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), ["batch_id"], block_size)
    output = StructType([StructField("seq", LongType())])
    return blocked_fold(rows, ["batch_id"], block, ["seq"], output, step, ["seq", "_at", "forced"])


def latest_snapshots(snapshots: DataFrame, keys: list[str], values: list[str], generation: int | None = None) -> DataFrame:
    """The newest queued snapshot per key; those of an older generation are dropped first."""
    rows = snapshots if generation is None else snapshots.filter(F.col("generation") == generation)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("_v"), F.max("seq").alias("seq"))
    return newest.select(*keys, "seq", *[F.col(f"_v.{v}").alias(v) for v in values])


