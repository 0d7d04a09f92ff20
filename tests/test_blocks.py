"""The plan for keys too large for one task gives the rows of the plain plan."""

import pytest
from pyspark.sql import functions as F

from voxtide.operators import cues, folds, frames, intervals, jobs, ordered, quality, speech, transcripts
from voxtide.plans import views

SF = "/root/testdata/sf0.001"


def same(plain, blocked):
    assert plain.columns == blocked.columns
    a, b = (sorted(map(repr, df.collect())) for df in (plain, blocked))
    assert a == b and a


def rough_frames(spark):
    at = F.col("frame_idx") + F.col("file_id")
    return views.frames(spark, SF).withColumn("start_sample", F.col("start_sample") + F.when(at % 11 == 0, 5).otherwise(0))


def responses(spark):
    return views.responses(spark, SF).filter("(session_id + seq) % 5 <> 3")


def durations(spark):
    return views.job_events(spark, SF).select("batch_id", "seq", F.floor("value").cast("bigint").alias("duration_ms"), F.lit(3).alias("remaining"))


def cue_table(spark):
    shifted = F.col("start_sample") - F.when(F.col("cue_idx") % 2 == 0, 12_000).otherwise(0)
    return views.cues(spark, SF).select("file_id", (F.col("cue_idx") + 1).alias("cue_no"), shifted.alias("start_ms"), F.col("end_sample").alias("end_ms"))


def turns(spark):
    return views.utterances(spark, SF).select("file_id", "idx", F.lit(5).alias("gap_before"), F.length("text").cast("bigint").alias("length"))


def classified(spark):
    return frames.classify(views.frames(spark, SF), views.FIXED)


CASES = {
    "frames": lambda s, b: frames.check_frames(rough_frames(s), b),
    "sequence": lambda s, b: intervals.check_sequence(views.manifest_utterances(s, SF), None, b),
    "latch": lambda s, b: speech.latch(classified(s), views.FIXED, b).select("file_id", "frame_idx", "in_speech"),
    "islands": lambda s, b: speech.islands(classified(s), views.FIXED, b),
    "detect": lambda s, b: speech.detect_speech(views.frames(s, SF), views.CAPPED, False, b),
    "adaptive": lambda s, b: speech.detect_speech(views.frames(s, SF), views.ADAPTIVE, True, b),
    "stages": lambda s, b: intervals.stage_timeline(views.utterances(s, SF), b),
    "timeline": lambda s, b: cues.timeline(turns(s), b),
    "regressing": lambda s, b: cues.regressing_cues(cue_table(s), b),
    "gaps": lambda s, b: transcripts.emission_gaps(responses(s), b),
    "transitions": lambda s, b: jobs.illegal_transitions(views.job_events(s, SF), b),
    "progress": lambda s, b: jobs.monotone_progress(views.job_events(s, SF), b).select("job_id", "seq", "shown_progress"),
    "late": lambda s, b: jobs.drop_late_progress(views.job_events(s, SF), b).select("job_id", "seq"),
    "durations": lambda s, b: jobs.rolling_durations(durations(s), ["batch_id"], b),
    "throttle": lambda s, b: jobs.throttle(views.job_events(s, SF), 600_000, b),
    "truth": lambda s, b: quality.ground_truth_rules(views.fixtures(s, SF), views.manifest_utterances(s, SF), b),
}
BLOCKS = {"frames": 16, "latch": 16, "islands": 16, "detect": 16, "adaptive": 32, "transitions": 64, "progress": 64, "late": 64, "durations": 64, "throttle": 250}


@pytest.mark.parametrize("name", CASES)
def test_blocks_change_nothing(spark, name):
    case = CASES[name]
    same(case(spark, None), case(spark, BLOCKS.get(name, 2)))


def test_time_blocks_and_next_rows(spark):
    events = views.table(spark, SF, "events")
    key, order = ["user_id"], ["ts", "event_id"]
    columns = ["event_id", "n", "following", "earlier", "known"]

    def build(rows, block):
        rows = ordered.row_index(rows, key, block, order, "n")
        rows = ordered.next_row(rows, key, block, order, ["event_id"], "following")
        rows = ordered.running_max(rows, key, block, order, F.col("value"), "earlier", inclusive=False)
        return ordered.running_last(rows, key, block, order, F.when(F.col("value") > 50, F.col("value")), "known").select(*columns)

    blocked, name = ordered.blocked_by(events, key, ordered.time_block(F.col("ts"), "day"), force=True)
    same(build(events, None), build(blocked, name))


def test_narrow_buckets_change_no_pair(spark):
    a, b = views.utterances(spark, SF), views.detected(spark, SF)
    columns = ["file_id", "a_idx", "b_idx"]
    same(intervals.overlap_pairs(a, b).select(columns), intervals.overlap_pairs(a, b, width=3_000).select(columns))
    same(intervals.best_matches(a, b), intervals.best_matches(a, b, width=3_000))


def test_keys_are_counted_only_for_large_inputs(spark):
    events = views.table(spark, SF, "events")
    assert ordered.fits_one_task(events, ["user_id"], limit=1)
    small, ordered.SMALL_INPUT = ordered.SMALL_INPUT, 0
    try:
        assert not ordered.fits_one_task(events, ["user_id"], limit=1)
        assert ordered.fits_one_task(events, ["user_id"])
    finally:
        ordered.SMALL_INPUT = small


def test_fixed_detection_shuffles_once(spark):
    plan = speech.detect_speech(views.frames(spark, SF), views.FIXED, adaptive=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text and "Python" not in text


def test_a_key_with_a_third_of_all_rows_is_divided(spark, monkeypatch):
    """Queries pick the blocked plan by themselves once a key is too large, and give the same rows."""
    events = views.table(spark, SF, "events")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    skewed = views.as_job_events(hot)

    def build():
        rows = jobs.monotone_progress(skewed).select("job_id", "seq", "shown_progress")
        bad = jobs.illegal_transitions(skewed).select("job_id", "seq", "rule")
        kept = jobs.throttle(skewed.withColumn("batch_id", F.col("job_id")), 600_000)
        return [sorted(map(repr, df.collect())) for df in (rows, bad, kept)]

    plain = build()
    assert len(plain[0]) == events.count()
    monkeypatch.setattr(ordered, "SMALL_INPUT", 0)
    monkeypatch.setattr(ordered, "KEY_ROWS", 100)
    monkeypatch.setattr(jobs, "BLOCK", 64)
    assert not ordered.fits_one_task(skewed, jobs.JOB)
    assert build() == plain


def test_rounds_of_a_fold_do_not_grow_with_its_blocks(spark, monkeypatch):
    # Evenly spaced events: whichever of them is taken as published first, the states of two blocks never meet.
    events = spark.range(640).selectExpr("id % 2 AS batch_id", "id AS seq", "timestamp_micros(id * 40000) AS ts", "false AS forced")
    counts = []
    cut = folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df: counts.append(1) or cut(df))
    plain = sorted(map(tuple, jobs.throttle(events).collect()))
    seen = set()
    for size in (160, 40, 20):
        counts.clear()
        assert sorted(map(tuple, jobs.throttle(events, block_size=size).collect())) == plain
        seen.add(len(counts))
    assert max(seen) <= 2 + 2 * folds.REPAIRS + 1
