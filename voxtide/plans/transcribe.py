"""Bulk transcription: recordings to caption documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.operators.cues import assemble_documents, clamp_cues
from voxtide.operators.listing import SKIPPED, conflicting_directories, escaping_work, output_collisions, pending_work
from voxtide.operators.ordered import KEY_ROWS
from voxtide.operators.recognize import Recognise, isolate_failures, recognize
from voxtide.operators.speech import NO_CAP, SCAN_BLOCK, detect_speech, failed_files, numbered, speech_pieces
from voxtide.options import DetectorOptions
from voxtide.session import cut_lineage
from voxtide.sources.ranges import Decoder
from voxtide.sources.wave import TASK_BYTES, TASK_FILES, interval_ranges, scan_frames, scan_wave, spread


@dataclass(frozen=True)
class Transcription:
    """Documents to write, and the state of every work item."""

    documents: DataFrame
    jobs: DataFrame


def check_plan(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """Reasons why a batch must not start: two inputs for one output, a folder in an output's place, a path that leaves the root."""
    clash = output_collisions(work).select(F.col("output_key").alias("path"), F.lit("several inputs map to this output").alias("reason"))
    folder = conflicting_directories(work, outputs).select(F.col("output_path").alias("path"), F.lit("a folder has this name").alias("reason"))
    outside = escaping_work(work).select(F.col("relative_path").alias("path"), F.lit("the path leaves the root").alias("reason"))
    return clash.unionByName(folder).unionByName(outside)


def transcribe(
    work: DataFrame,
    outputs: DataFrame,
    load_model: Callable[[], Any],
    recognise: Recognise,
    policy: str = "skip",
    options: DetectorOptions | None = None,
    decoder: Decoder | None = None,
    task_bytes: int = TASK_BYTES,
) -> Transcription:
    """Detects, recognises and formats everything pending.

    ``work(input_path, relative_path, output_path)`` is the plan; recordings are opened by their ``input_path``, which
    every executor must reach. A plan that must not start (``check_plan``) is an error. Finished work is removed first, so
    nothing of it is read further. A recording that is missing, or that cannot be read, cut into speech or recognised,
    fails alone and gets no document.

    Of each recording the header is read for its layout, the samples once for their levels, and the samples of its
    speech once for the recogniser, each in the task that needs them: what is kept between the steps is layouts, levels and
    texts. With a ``decoder`` a recording is decoded for each of these steps, and is never written.
    """
    options = options or DetectorOptions()
    refused = check_plan(work, outputs).limit(5).collect()
    if refused:
        raise ValueError("the batch must not start: " + "; ".join(f"{r.path}: {r.reason}" for r in refused))
    pending = cut_lineage(pending_work(work, outputs, policy))
    files = pending.select(F.col("input_path").alias("path"))
    layouts = cut_lineage(scan_wave(spread(files, F.lit(1), TASK_FILES, "path"), decoder))
    # Levels are a fraction of the audio; with them no later step, nor a second look at one, reads it again.
    scored = cut_lineage(scan_frames(layouts, options.frame_samples, task_bytes, decoder))
    lost = scored.filter("error IS NOT NULL").groupBy("file_id").agg(F.min("error").alias("error"))
    failed = layouts.filter("error IS NOT NULL").select(F.col("path").alias("file_id"), "error").unionByName(lost)
    frames = scored.filter("error IS NULL").drop("error")
    # The layouts tell how long the longest recording is; no frame is read to count them.
    longest = (layouts.agg(F.max("data_length")).first()[0] or 0) // (2 * options.frame_samples)
    block = SCAN_BLOCK if longest > KEY_ROWS else 0
    if options.forced_piece_can_fail and options.segmenter.max_segment < NO_CAP:
        failed = failed.unionByName(failed_files(speech_pieces(frames, options, block_size=block), options))
    failed = cut_lineage(failed.groupBy("file_id").agg(F.min("error").alias("error")))
    good = layouts.join(failed.select(F.col("file_id").alias("path")), "path", "left_anti")
    intervals = cut_lineage(numbered(detect_speech(frames, options, block_size=block)))
    # The recogniser is the expensive step: its result is kept, so that no later branch runs it again.
    ranges = interval_ranges(intervals, good, task_bytes, whole=decoder is not None)
    spoken = cut_lineage(recognize(ranges, load_model, recognise, decoder))
    states = isolate_failures(good.select(F.col("path").alias("file_id")), spoken)
    states = states.unionByName(failed.select("file_id", F.lit("Failed").alias("state"), "error"))
    complete = states.filter("state = 'Complete'").select("file_id")
    cues = spoken.join(complete, "file_id", "left_semi").select("file_id", F.col("idx").alias("cue_idx"), "start_sample", "end_sample", "text")
    documents = assemble_documents(clamp_cues(cues), complete)
    outputs_of = pending.select(F.col("input_path").alias("file_id"), "output_path")
    counts = documents.groupBy("file_id").agg(F.sum("cue_count").alias("cue_count"))
    jobs = (
        work.select(F.col("input_path").alias("file_id"), "relative_path", "output_path")
        .join(states, "file_id", "left")
        .join(counts, "file_id", "left")
        .select(
            "relative_path",
            "output_path",
            F.coalesce("state", F.lit("Cancelled") if policy == "cancel" else F.lit("Complete")).alias("state"),
            F.when(F.col("state").isNull(), F.lit("Cancelled before start") if policy == "cancel" else F.lit(SKIPPED))
            .otherwise(F.coalesce("error", F.lit("Complete")))
            .alias("detail"),
            F.coalesce("cue_count", F.lit(0)).alias("cue_count"),
        )
    )
    return Transcription(documents.join(outputs_of, "file_id"), jobs)
