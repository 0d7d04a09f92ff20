"""Evaluation and audit jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.timecode import ms_to_samples
from voxtide.operators.audit import audit_runs, compare_folders, repeatability
from voxtide.operators.cues import document_errors, parse_documents
from voxtide.operators.intervals import check_sequence, detection_metrics
from voxtide.operators.transcripts import cue_agreement, transcript_diagnostics, transcript_rollup
from voxtide.session import cut_lineage
from voxtide.sources.files import scan_vtt


def evaluate_detection(
    expected: DataFrame, detected: DataFrame, tolerance_ms: int = 250, max_segment: int = 400_000
) -> DataFrame:
    """Detection metrics of the recordings whose two interval lists are in order, with the corpus row (null file).

    The lists are checked first, in a job of its own; its result, the few files that fail, is kept, and where there
    are none the metrics read their inputs as they are.
    """
    bad = check_sequence(expected).select("file_id").unionByName(check_sequence(detected).select("file_id")).distinct()
    bad = cut_lineage(bad)
    if not bad.isEmpty():
        expected, detected = (df.join(bad, "file_id", "left_anti") for df in (expected, detected))
    return detection_metrics(expected, detected, tolerance_ms, max_segment, roll_up=True)


def evaluate_transcripts(expected: DataFrame, produced: DataFrame, normalized: bool = False) -> DataFrame:
    """Transcript diagnostics per recording from utterances and produced intervals with text."""
    return transcript_diagnostics(expected, produced, normalized)


def evaluate_documents(expected: DataFrame, parsed_cues: DataFrame, normalized: bool = False) -> DataFrame:
    """Transcript diagnostics straight from parsed caption documents, with the column ``error``.

    A document with any error is rejected as a whole: its row has the first error and no figures. What was parsed is
    kept, so that documents are read once.
    """
    parsed_cues = cut_lineage(parsed_cues)
    bad = cut_lineage(document_errors(parsed_cues))
    cues = parsed_cues.filter("error IS NULL").join(bad.select("file_id"), "file_id", "left_anti")
    produced = cues.select(
        "file_id",
        F.col("cue_no").alias("idx"),
        ms_to_samples(F.col("start_ms")).alias("start_sample"),
        ms_to_samples(F.col("end_ms")).alias("end_sample"),
        "text",
    )
    good = transcript_diagnostics(expected.join(bad.select("file_id"), "file_id", "left_anti"), produced, normalized)
    rejected = expected.select("file_id").distinct().join(bad, "file_id")
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)


@dataclass(frozen=True)
class TranscriptReport:
    """Evaluated caption files: a row per recording, the cues that differ from their utterances, and the corpus."""

    recordings: DataFrame
    disagreements: DataFrame
    corpus: DataFrame


def evaluate_files(folder: str, names: DataFrame, expected: DataFrame, normalized: bool = False) -> TranscriptReport:
    """Caption files below ``folder`` against what was said: reading, parsing, agreement, word edits and roll-up.

    ``names(file_id, relative_path)`` says which file is a recording's, and ``expected(file_id, idx, start_sample,
    end_sample, text)`` what it should hold. A recording whose file is missing, is no UTF-8, or breaks the format has that as its
    ``error`` and no figures; the corpus row and the disagreements are of the others. Files that no name asks for are not read
    further. Without utterances there are no rows, and a corpus of 0 recordings.
    """
    spark = expected.sparkSession
    base = folder.rstrip("/").removeprefix("file:")
    found = scan_vtt(spark, folder).select(F.substring("path", len(base) + 2, 1 << 30).alias("relative_path"), "text", "error")
    read = cut_lineage(names.select("file_id", "relative_path").join(found, "relative_path", "left"))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("text").isNull(), F.lit("the document is missing"))
    unread = read.filter("error IS NOT NULL OR text IS NULL").select("file_id", reason.alias("error"))
    parsed = cut_lineage(parse_documents(read.filter("error IS NULL AND text IS NOT NULL").select("file_id", "text")))
    there = expected.join(unread.select("file_id"), "file_id", "left_anti")
    rows = evaluate_documents(there, parsed, normalized)
    lost = expected.select("file_id").distinct().join(unread, "file_id")
    recordings = cut_lineage(rows.unionByName(lost, allowMissingColumns=True))
    good = recordings.filter("error IS NULL")
    ids = good.select("file_id")
    cues = parsed.filter("error IS NULL").join(ids, "file_id", "left_semi")
    return TranscriptReport(recordings, cue_agreement(there.join(ids, "file_id", "left_semi"), cues, normalized), transcript_rollup(good))


@dataclass(frozen=True)
class RunComparison:
    """Two runs: folders with their digests' verdict, and the files that differ."""

    folders: DataFrame
    differences: DataFrame


def compare_runs(current: DataFrame, baseline: DataFrame) -> RunComparison:
    """What two runs' outputs ``relative_path, has_header, sha256`` have in common, as a tree of folder digests.

    Only files in folders whose digests differ are held against each other; runs that agree end with the folders.
    ``differences`` are the files that are not in both with the same bytes.
    """
    folders = cut_lineage(compare_folders(current, baseline))
    differing = folders.filter("NOT same").select(F.col("folder").alias("_folder"))
    own = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    inside = lambda run: run.join(differing, own == F.col("_folder"), "left_semi")
    rows = repeatability(inside(current), inside(baseline))
    return RunComparison(folders, rows.filter("NOT byte_identical"))


def audit_run(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    return audit_runs(runs, evidence)
