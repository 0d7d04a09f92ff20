"""Comparing runs and auditing what a run left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import has_vtt_header, is_header_only
from voxtide.operators.intervals import sequences_equal
from voxtide.operators.listing import SKIPPED


def layout_pairs(observations: DataFrame, flat_intervals: DataFrame, nested_intervals: DataFrame) -> DataFrame:
    """Whether the flat and the nested copy of each fixture gave the same result.

    ``observations(file_id, layout, file_sha, pcm_sha, sample_count)`` must have exactly one row per layout.
    """
    side = lambda name, column: F.max(F.when(F.col("layout") == name, F.col(column)))
    rows = observations.groupBy("file_id").agg(
        F.count_if(F.col("layout") == "flat").alias("flat_rows"),
        F.count_if(F.col("layout") == "nested").alias("nested_rows"),
        *[
            side("flat", c).eqNullSafe(side("nested", c)).alias(f"{c}_match")
            for c in ("file_sha", "pcm_sha", "sample_count")
        ],
    )
    # Only intervals of observed fixtures take part; a fixture without any on either side agrees.
    equal = sequences_equal(flat_intervals, nested_intervals).select("file_id", F.col("equal").alias("intervals_match"))
    rows = rows.join(equal, "file_id", "left").withColumn("intervals_match", F.coalesce("intervals_match", F.lit(True)))
    one_each = (F.col("flat_rows") == 1) & (F.col("nested_rows") == 1)
    checks = ("file_sha_match", "pcm_sha_match", "sample_count_match", "intervals_match")
    every = one_each
    for c in checks:
        every = every & F.col(c)
    return rows.withColumn("all_match", every)


def media_delta(observations: DataFrame) -> DataFrame:
    """Decoded minus master samples and interval counts, per layout."""
    return observations.groupBy("layout").agg(
        F.count(F.lit(1)).alias("inputs"),
        F.sum(F.col("decoded_samples") - F.col("master_samples")).alias("sample_delta"),
        F.sum("interval_count").alias("intervals"),
    )


def repeatability(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Outputs of two runs side by side: present in both, header on the baseline, same bytes.

    Runs have ``relative_path, has_header, sha256`` for the outputs that exist.
    """
    left = current.select("relative_path", F.lit(True).alias("_c"), F.col("sha256").alias("_cs"))
    right = baseline.select("relative_path", F.lit(True).alias("_p"), F.col("sha256").alias("_ps"), F.col("has_header").alias("_h"))
    rows = left.join(right, "relative_path", "full")
    present = lambda c: F.coalesce(F.col(c), F.lit(False))
    identical = present("_c") & present("_p") & F.col("_cs").eqNullSafe(F.col("_ps"))
    verdict = (
        F.when(~present("_c"), "no current output")
        .when(~present("_p"), "no baseline output")
        .when(~present("_h"), "baseline without header")
        .when(~identical, "bytes differ")
        .otherwise("identical")
    )
    return rows.select(
        "relative_path",
        present("_c").alias("in_current"),
        present("_p").alias("in_baseline"),
        identical.alias("byte_identical"),
        verdict.alias("verdict"),
    )


def folder_digests(outputs: DataFrame) -> DataFrame:
    """Every folder of ``outputs(relative_path, sha256)`` with the number of files below it, at any depth, and two sums of
    hashes over their paths and contents, which do not depend on order: ``folder, files, d1, d2`` (the root is ``''``).

    A file adds a row for each folder above it, which partial sums reduce to the folders of a task at once.
    """
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hashed = lambda *c: F.xxhash64(*c, "relative_path", "sha256").cast("decimal(38,0)")
    rows = outputs.select(hashed().alias("_a"), hashed(F.lit(1)).alias("_b"), F.explode(above).alias("folder"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("_a").alias("d1"), F.sum("_b").alias("d2"))


def compare_folders(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Folders of either run: ``folder, files_current, files_baseline, same``."""
    left, right = (folder_digests(run).select("folder", *[F.col(c).alias(f"{c}_{side}") for c in ("files", "d1", "d2")]) for run, side in ((current, "c"), (baseline, "b")))
    count = lambda side: F.coalesce(f"files_{side}", F.lit(0)).cast("bigint")
    same = (F.col("files_c") == F.col("files_b")) & (F.col("d1_c") == F.col("d1_b")) & (F.col("d2_c") == F.col("d2_b"))
    return left.join(right, "folder", "full").select(
        "folder", count("c").alias("files_current"), count("b").alias("files_baseline"), F.coalesce(same, F.lit(False)).alias("same")
    )


def provenance(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against their manifest entries: unknown, ambiguous, or with another hash; and entries without a file.

    ``listing(path, sha256)`` and ``manifest(path, sha256)``; paths are compared ignoring case. Entries are counted per
    path before the join, so a path with many entries adds one row, not many. An entry that no file has is a row with
    its own path (the first in order, of several).
    """
    entries = manifest.groupBy(F.lower("path").alias("_key")).agg(
        F.count(F.lit(1)).alias("matches"), F.min(F.upper("sha256")).alias("_want"), F.min("path").alias("_entry")
    )
    rows = listing.withColumns({"_key": F.lower("path"), "_file": F.lit(True)}).join(entries, "_key", "full")
    rows = rows.withColumn("path", F.coalesce("path", "_entry"))
    matches = F.coalesce("matches", F.lit(0)).cast("bigint")
    verdict = (
        F.when(F.col("_file").isNull(), "no file")
        .when(matches == 0, "not in manifest")
        .when(matches > 1, "ambiguous")
        .when(F.upper("sha256") != F.col("_want"), "hash differs")
        .otherwise("ok")
    )
    return rows.select("path", matches.alias("matches"), verdict.alias("verdict"))


def output_evidence(work: DataFrame, outputs: DataFrame, sentinels: DataFrame | None = None) -> DataFrame:
    """What is at every work item's output path.

    ``outputs(path, text, length, sha256)``; ``sentinels(path, sentinel_sha)`` are the files placed before the run.
    """
    found = outputs.select(
        F.lower("path").alias("_key"),
        F.lit(True).alias("_there"),
        has_vtt_header(F.col("text"), strict=False).alias("_h"),
        is_header_only(F.col("text")).alias("_ho"),
        F.col("length").alias("_len"),
        F.col("sha256").alias("_sha"),
    )
    rows = work.withColumn("_key", F.lower("output_path")).join(found, "_key", "left")
    if sentinels is not None:
        rows = rows.join(sentinels.select(F.lower("path").alias("_key"), "sentinel_sha"), "_key", "left")
    else:
        rows = rows.withColumn("sentinel_sha", F.lit(None).cast("string"))
    false = F.lit(False)
    return rows.select(
        "relative_path",
        "output_path",
        F.coalesce("_there", false).alias("exists"),
        F.coalesce("_h", false).alias("has_header"),
        F.coalesce("_ho", false).alias("header_only"),
        F.coalesce("_len", F.lit(0)).cast("bigint").alias("length"),
        F.col("_sha").alias("sha256"),
        F.col("sentinel_sha").isNotNull().alias("preseeded"),
        (F.col("sentinel_sha").isNotNull() & F.col("sentinel_sha").eqNullSafe(F.col("_sha"))).alias("preserved"),
    )


def snapshot_changes(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed upsert: what to insert, update, leave or delete, in the incoming order. Keys ignore case."""
    mine = current.select(F.lower(key).alias("_key"), F.struct(*columns).alias("_old"))
    theirs = incoming.select(F.lower(key).alias("_key"), F.struct(*columns).alias("_new"), F.col("position").alias("position"))
    rows = mine.join(theirs, "_key", "full")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "keep")
        .otherwise("update")
    )
    value = F.coalesce("_new", "_old")
    return rows.select(
        F.col("_key").alias("key"), change.alias("change"), "position", *[value[c].alias(c) for c in columns]
    )


# What each scenario must end with: the rules that apply to a job row joined with its output evidence. A rule is a
# condition that holds for a violation; ``all`` applies to every scenario.
def _rules() -> dict[str, dict[str, Column]]:
    state, exists, header = F.col("state"), F.col("exists"), F.col("has_header")
    seeded, kept = F.col("preseeded"), F.col("preserved")
    sentinel = {"no sentinel": ~seeded, "sentinel changed": seeded & ~kept}
    return {
        "all": {"output without header": exists & ~header},
        "success": {"not complete": state != "Complete", "no valid output": ~exists | ~header},
        "cancellation": dict(sentinel),
        "skip": {
            "not complete": state != "Complete",
            "not skipped": ~F.coalesce(F.col("detail") == SKIPPED, F.lit(False)),
            **sentinel,
        },
        "collision-cancel": {"not cancelled": state != "Cancelled", **sentinel},
        "overwrite": {"not complete": state != "Complete", "not replaced": ~seeded | kept},
        "write-failure": {"not failed": state != "Failed", **sentinel},
        "write-denied": {"not failed": state != "Failed", "output left": exists},
        "recognizer-failure": dict(sentinel),
        "empty-response": {
            "not complete": state != "Complete",
            "has cues": F.coalesce(F.col("cue_count"), F.lit(0)) != 0,
            "not header only": ~exists | ~F.col("header_only"),
        },
        "mixed-failure": {
            "state": ~state.isin("Complete", "Failed"),
            "no sentinel": ~seeded,
            "failed job changed its output": (state == "Failed") & seeded & ~kept,
            "complete job left its sentinel": (state == "Complete") & seeded & kept,
            "complete job without valid output": (state == "Complete") & ~(exists & header),
        },
    }


# What must hold over a whole run, beyond its rows: name -> condition on the aggregated counters for a violation.
def _run_rules() -> dict[str, dict[str, Column]]:
    ended = lambda stage: F.coalesce(F.col("final_stage") != stage, F.lit(True))
    cancelled = {"cancelled": F.col("was_cancelled")}
    preflight = {"no preflight stage": ~F.col("saw_preflight")}
    no_model = {"model loaded": F.col("saw_model_load")}
    incomplete = {"jobs missing": F.col("jobs") != F.col("expected_jobs")}
    closed = {**cancelled, **incomplete, "not ended": ended("Complete")}
    return {
        "all": {"fatal error": F.col("fatal_error").isNotNull(), "temporary files left": F.col("temporary_files") > 0},
        "success": closed,
        "cancellation": {"not cancelled": ~F.col("was_cancelled") & ended("Cancelled")},
        "skip": {**closed, **preflight, **no_model},
        "collision-cancel": {**cancelled, **incomplete, **preflight, **no_model, "not ended": ended("Cancelled")},
        "overwrite": {**closed, **preflight},
        "write-failure": {**closed, **preflight},
        "write-denied": {**closed, "never wrote": ~F.col("saw_writing")},
        "recognizer-failure": {**cancelled, "no failed job": F.col("failed") == 0},
        "empty-response": closed,
        "mixed-failure": {**closed, "no failed job": F.col("failed") == 0, "no complete job": F.col("complete") == 0},
    }


# The names of the scenarios, which evidence of other runs uses as well.
SCENARIOS = (
    "success",
    "cancellation",
    "skip",
    "collision-cancel",
    "overwrite",
    "write-failure",
    "write-denied",
    "recognizer-failure",
    "empty-response",
    "mixed-failure",
)


def _violated(scenario: Column, rules: dict[str, dict[str, Column]]) -> Column:
    found = []
    for name, conditions in rules.items():
        applies = F.lit(True) if name == "all" else scenario == name
        found += [F.when(applies & c, F.lit(rule)) for rule, c in conditions.items()]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def audit_jobs(evidence: DataFrame) -> DataFrame:
    """Rule violations per job: ``evidence`` is a job row with its scenario and its output evidence.

    A projection only; the rules of all scenarios are checked in one pass over all runs.
    """
    return evidence.select(
        "run_id", "scenario", "output_path", F.explode(_violated(F.col("scenario"), _rules())).alias("rule")
    )


def audit_runs(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict per run: ``runs(run_id, scenario, expected_jobs, final_stage, was_cancelled, saw_preflight,
    saw_model_load, saw_writing, fatal_error, temporary_files)`` with its job rows."""
    row_rules = F.size(_violated(F.col("scenario"), _rules()))
    jobs = evidence.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("state") == "Complete").alias("complete"),
        F.count_if(F.col("state") == "Failed").alias("failed"),
        F.count_if(F.col("state") == "Cancelled").alias("cancelled"),
        F.sum(row_rules).alias("job_violations"),
    )
    counts = ("jobs", "complete", "failed", "cancelled", "job_violations")
    rows = runs.join(jobs, "run_id", "left").fillna(0, list(counts))
    rows = rows.withColumn("run_violations", F.array_sort(_violated(F.col("scenario"), _run_rules())))
    passed = (F.col("job_violations") == 0) & (F.size("run_violations") == 0)
    return rows.select("run_id", "scenario", *counts, "run_violations", passed.alias("passed"))
