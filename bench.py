"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxtide.plans.queries import QUERIES  # noqa: E402
from voxtide.session import local_session  # noqa: E402

HEADLINE = [
    "vtt_documents",
    "vtt_round_trip",
    "clamped_cues",
    "detect_fixed",
    "detect_capped",
    "detect_adaptive",
    "latch_states",
    "frame_energy",
    "detection_metrics",
    "best_matches",
    "overlap_pairs",
    "transcript_diagnostics",
    "word_edits",
    "document_diagnostics",
    "bulk_transcription",
    "accumulated_transcripts",
    "pending_skip",
    "current_jobs",
    "illegal_transitions",
    "monotone_progress",
    "throttled_events",
    "repeatability",
    "run_audit",
    "ground_truth_rules",
    "normalized_text",
    "stream_detect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)

    def timed(name: str, folder: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    # Each query runs once at the smaller size, whose time is the second figure and whose run compiles it; then
    # twice at the size asked for, of which the better counts.
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    small = {name: timed(name, small_dir) for name in HEADLINE}
    seconds = {name: min(timed(name, sf_dir) for _ in range(2)) for name in HEADLINE}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    cues = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "first_run_at_sf0.01": small,
        "rates": {
            "frames_per_sec_fixed": round(events / seconds["detect_fixed"]),
            "frames_per_sec_adaptive": round(events / seconds["detect_adaptive"]),
            "cues_per_sec_documents": round(cues / seconds["vtt_documents"]),
        },
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
