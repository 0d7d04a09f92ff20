"""File listings, output planning and set comparisons.

A listing has ``path, is_dir, length, modified``; work items have ``input_path, relative_path, output_path``. Output
paths are compared without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.paths import escapes_root, path_order, relative_output_path

# How an interrupted commit's temporary file is named, and the age after which it counts as abandoned.
TEMPORARY_PREFIX, TEMPORARY_SUFFIX, STALE_DAYS = ".voxtide-vtt.", ".tmp", 7
# Fixed value: the detail of a job whose output was there already.
SKIPPED = "Existing VTT skipped"


def plan_work(inputs: DataFrame, output_root: str) -> DataFrame:
    """Work items for ``inputs(input_path, relative_path)``, mirrored below the output root."""
    target = F.concat(F.lit(output_root.rstrip("/\\") + "/"), relative_output_path(F.col("relative_path")))
    return inputs.select("input_path", "relative_path", target.alias("output_path"))


def escaping_work(inputs: DataFrame) -> DataFrame:
    """Inputs whose relative path leaves its root."""
    return inputs.filter(escapes_root(F.col("relative_path")))


def _key(path: str = "output_path") -> Column:
    return F.lower(F.col(path)).alias("_key")


def existing_outputs(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """Work items whose output file is there already."""
    files = outputs.filter("NOT is_dir").select(_key("path"))
    return work.withColumn("_key", _key()).join(files, "_key", "left_semi").drop("_key")


def conflicting_directories(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """Work items with a folder in the place of their output."""
    folders = outputs.filter("is_dir").select(_key("path"))
    return work.withColumn("_key", _key()).join(folders, "_key", "left_semi").drop("_key")


def pending_work(work: DataFrame, outputs: DataFrame, policy: str = "skip") -> DataFrame:
    """Items to process: ``skip`` leaves out existing outputs, ``overwrite`` takes all, ``cancel`` none if any exists."""
    if policy == "overwrite":
        return work
    if policy not in ("skip", "cancel"):
        raise ValueError(f"unknown policy {policy!r}")
    files = outputs.filter("NOT is_dir").select(_key("path"))
    if policy == "skip":
        return work.withColumn("_key", _key()).join(files, "_key", "left_anti").drop("_key")
    return work.filter(~existing_outputs(work, outputs).exists())


def output_collisions(work: DataFrame) -> DataFrame:
    """Output paths that more than one input maps to."""
    return (
        work.groupBy(F.lower("output_path").alias("output_key"))
        .agg(F.count(F.lit(1)).alias("inputs"), F.min("input_path").alias("first_input"))
        .filter("inputs > 1")
    )


def ordered_paths(listing: DataFrame, column: str = "relative_path") -> DataFrame:
    return listing.orderBy(*path_order(F.col(column)))


def missing_paths(left: DataFrame, right: DataFrame, column: str = "path") -> DataFrame:
    """Rows of ``left`` whose path is not in ``right``, ignoring case."""
    keys = right.select(F.lower(column).alias("_key"))
    return left.withColumn("_key", F.lower(column)).join(keys, "_key", "left_anti").drop("_key")


def set_differences(actual: DataFrame, referenced: DataFrame, column: str = "path") -> DataFrame:
    """Paths on one side only: ``unexpected`` files and ``missing`` references. Empty when the sets are equal."""
    sides = actual.select(F.lower(column).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(
        referenced.select(F.lower(column).alias("key"), F.lit(0).alias("a"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy("key").agg(F.max("a").alias("a"), F.max("r").alias("r")).filter("a <> r")
    return seen.select("key", F.when(F.col("a") == 1, F.lit("unexpected")).otherwise(F.lit("missing")).alias("rule"))


def stale_artifacts(listing: DataFrame, now: Column) -> DataFrame:
    """Temporary files of interrupted commits older than a week; reports only, deletes nothing."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    prefix, suffix = (s.replace(".", r"\.") for s in (TEMPORARY_PREFIX, TEMPORARY_SUFFIX))
    owned = name.rlike(rf"\A{prefix}[0-9A-Fa-f]{{32}}{suffix}\z")
    old = F.col("modified") <= now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    return listing.filter(~F.col("is_dir") & owned & old)


def discovery_summary(listing: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files found, issues, the first issue, and whether the run may start."""
    trouble = F.struct(F.lower("path").alias("k"), "path", "reason")
    rows = listing.select(F.lit(None).cast("struct<k:string,path:string,reason:string>").alias("_t"))
    rows = rows.unionByName(issues.select(trouble.alias("_t")))
    summary = rows.agg(F.count_if(F.col("_t").isNull()).alias("files"), F.count("_t").alias("issues"), F.min("_t").alias("_first"))
    first = F.format_string("'%s': %s", F.col("_first.path"), F.col("_first.reason"))
    message = (
        F.when(F.col("issues") == 1, F.concat(F.lit("Unreadable: "), first))
        .when(F.col("issues") > 1, F.concat(F.col("issues"), F.lit(" unreadable places, beginning with "), first))
        .when(F.col("files") == 0, F.lit("Nothing to transcribe here"))
    )
    return summary.select("files", "issues", message.alias("message"), message.isNull().alias("can_run"))
