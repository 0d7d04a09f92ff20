"""Caption cues: timeline, clamping, document assembly and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtide.functions.scalars import is_valid_interval
from voxtide.functions.text import has_vtt_header, is_blank, sanitize_text
from voxtide.functions.timecode import format_timestamp, int_div, ms_to_samples, parse_timestamp, samples_to_ms
from voxtide.operators.ordered import (
    BLOCK,
    block_of,
    blocked_by,
    local_window,
    previous_row,
    rows_to_here,
    running_sum,
)

HEADER = "WEBVTT\n\n"
# Cues per document part: a document of any length is a sequence of bounded parts.
PART_CUES = 4_096
VALUE_BLOCK = BLOCK * 320

# White space other than the line feed, for the inside of one line.
_W = r"\p{Z}\t\x{0B}-\r\x{85}"
_TIME = r"([0-9]{2,}:[0-5][0-9]:[0-5][0-9]\.[0-9]{3})"
_TIMING = rf"\A[{_W}]*{_TIME}[{_W}]*-->[{_W}]*{_TIME}(?=[{_W}]|\z)"


def timeline(utterances: DataFrame, block_size: int | None = None) -> DataFrame:
    """Places utterances one after another: ``file_id, idx, gap_before, length`` to start and end samples."""
    rows, block = blocked_by(utterances, ["file_id"], block_of(F.col("idx"), block_size or BLOCK), force=bool(block_size))
    rows = running_sum(rows, ["file_id"], block, ["idx"], F.col("gap_before") + F.col("length"), "end_sample")
    return rows.withColumn("start_sample", F.col("end_sample") - F.col("length")).drop("_b", "gap_before", "length")


def clamp_cues(cues: DataFrame, normalized: bool = False, block_samples: int | None = None) -> DataFrame:
    """Caption cues in time order with strictly positive, non-overlapping millisecond ranges.

    Invalid intervals and texts that clean to nothing are dropped. Each cue starts no earlier than the one before
    ends and lasts at least one millisecond; with i the cue number, that recursion has the closed form
    ``end_i = i + max(0, max_{j<=i}(max(s_j + 1, e_j) - j))``, a running maximum.
    """
    valid = is_valid_interval(F.col("start_sample"), F.col("end_sample"))
    rows = cues.filter(valid).withColumn("text", sanitize_text(F.col("text"), normalized)).filter("text <> ''")
    rows, block = blocked_by(
        rows, ["file_id"], int_div(F.col("start_sample"), block_samples or VALUE_BLOCK), force=bool(block_samples)
    )
    order = ["start_sample", "end_sample", "cue_idx"]
    rows = rows.withColumn("_s", samples_to_ms(F.col("start_sample"))).withColumn("_e", samples_to_ms(F.col("end_sample")))
    rank = F.row_number().over(local_window(["file_id"], block, order)).cast("bigint")
    rows = rows.withColumn("_r", rank).withColumn("_x", F.greatest(F.col("_s") + 1, F.col("_e")) - F.col("_r"))
    rows = rows.withColumn("_cn", F.lit(0).cast("bigint")).withColumn("_cx", F.lit(0).cast("bigint"))
    if block:
        rows = _clamp_carry(rows.drop("_cn", "_cx"), block)
    here = rows_to_here(["file_id"], block, order)
    earlier = local_window(["file_id"], block, order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("_cn") + F.col("_r")
    upto = F.greatest(F.max("_x").over(here) - F.col("_cn"), F.col("_cx"))
    before = F.greatest(F.max("_x").over(earlier) - F.col("_cn"), F.col("_cx"))
    placed = rows.select("file_id", n.alias("cue_no"), "_s", upto.alias("_upto"), before.alias("_before"), "text")
    previous_end = F.when(F.col("cue_no") > 1, F.col("cue_no") - 1 + F.col("_before")).otherwise(F.lit(0))
    return placed.select(
        "file_id",
        "cue_no",
        F.greatest(previous_end, F.col("_s")).alias("start_ms"),
        (F.col("cue_no") + F.greatest("_upto", F.lit(0))).alias("end_ms"),
        "text",
    )


def _clamp_carry(rows: DataFrame, block: str) -> DataFrame:
    """Cue count and running maximum before each block; the maximum is relative to file-wide cue numbers."""
    earlier = Window.partitionBy("file_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    summary = rows.groupBy("file_id", block).agg(F.count(F.lit(1)).alias("_n"), F.max("_x").alias("_m"))
    summary = summary.withColumn("_cn", F.coalesce(F.sum("_n").over(earlier), zero))
    summary = summary.withColumn("_cx", F.greatest(F.max(F.col("_m") - F.col("_cn")).over(earlier), zero))
    return rows.join(summary.drop("_n", "_m"), ["file_id", block])


def assemble_documents(cues: DataFrame, files: DataFrame | None = None, part_cues: int = PART_CUES) -> DataFrame:
    """Caption documents as ``file_id, part_no, text, cue_count``.

    The texts of a file's parts, one after another, are its document; up to ``part_cues`` cues make one part, so an
    ordinary file is one row. ``files`` adds the files without any cue, which get the bare header.
    """
    block = F.concat(
        format_timestamp(F.col("start_ms")), F.lit(" --> "), format_timestamp(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n")
    )
    parts = (
        cues.select("file_id", int_div(F.col("cue_no") - 1, part_cues).alias("part_no"), F.struct("cue_no", block.alias("block")).alias("c"))
        .groupBy("file_id", "part_no")
        .agg(F.array_sort(F.collect_list("c")).alias("c"))
        .select(
            "file_id",
            "part_no",
            F.array_join(F.transform("c", lambda x: x["block"]), "").alias("text"),
            F.size("c").cast("bigint").alias("cue_count"),
        )
    )
    if files is not None:
        parts = files.select("file_id").join(parts, "file_id", "left")
    part_no = F.coalesce("part_no", F.lit(0).cast("bigint"))
    body = F.coalesce("text", F.lit(""))
    return parts.select(
        "file_id",
        part_no.alias("part_no"),
        F.when(part_no == 0, F.concat(F.lit(HEADER), body)).otherwise(body).alias("text"),
        F.coalesce("cue_count", F.lit(0).cast("bigint")).alias("cue_count"),
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    """Cues and errors of caption documents: one row per cue block, one row for a document without header.

    A pure projection of each row: blocks are cut, read and compared with their neighbours inside the row's arrays, so
    nothing is shuffled. ``documents(file_id, text)`` may have ``part_no``; later parts have no header of their own.
    Then one row per part carries the number of cues, the last end and the header to the parts behind it, so that a
    document gives the same rows however it is cut.
    """
    first = (F.col("part_no") == 0) if "part_no" in documents.columns else F.lit(True)
    keys = ["file_id", "part_no"] if "part_no" in documents.columns else ["file_id"]
    text = F.regexp_replace(F.regexp_replace(F.col("text"), r"\A\x{FEFF}", ""), r"\r\n?", "\n")
    body = F.when(first, F.regexp_replace("_text", r"\A[^\n]*\n?", "")).otherwise(F.col("_text"))
    chunks = F.split(F.regexp_replace(body, rf"\A(?:[{_W}]*\n)+", ""), rf"\n(?:[{_W}]*\n)+(?!\z)|\n(?:[{_W}]*\n)*[{_W}]*\z")
    rows = documents.select(*keys, text.alias("_text")).select(
        *keys,
        (~first | has_vtt_header(F.regexp_extract("_text", r"\A[^\n]*", 0))).alias("_header"),
        F.filter(chunks, lambda c: ~is_blank(c)).alias("_chunks"),
    )

    # One step per transform: an expression that a lambda uses twice is also computed twice.
    def stamps(chunk: Column) -> Column:
        lines = F.split(chunk, "\n")
        part = lambda line, group: F.regexp_extract(F.get(lines, F.lit(line)), _TIMING, group)
        return F.struct(
            lines.alias("lines"), *[part(line, g).alias(f"t{line}{g}") for line in (0, 1) for g in (1, 2)]
        )

    def times(c: Column) -> Column:
        return F.struct(c["lines"].alias("lines"), *[parse_timestamp(c[t]).alias(t) for t in ("t01", "t02", "t11", "t12")])

    def read(c: Column) -> Column:
        one, two = c["t02"] > c["t01"], c["t12"] > c["t11"]
        skip = F.when(one, F.lit(1)).otherwise(F.lit(2))
        pick = lambda a, b: F.when(one, a).when(two, b)
        words = F.when(F.size(c["lines"]) > skip, F.array_join(F.slice(c["lines"], skip + 1, F.size(c["lines"])), " "))
        return F.struct(
            pick(c["t01"], c["t11"]).alias("start_ms"),
            pick(c["t02"], c["t12"]).alias("end_ms"),
            F.coalesce(words, F.lit("")).alias("text"),
        )

    rows = rows.withColumn("_cues", F.transform(F.transform(F.transform("_chunks", stamps), times), read))
    if "part_no" in keys:
        rows = rows.join(_before_parts(rows), keys)
    else:
        rows = rows.withColumns({"_n": F.lit(0).cast("bigint"), "_end": F.lit(None).cast("bigint")})
    cues = F.transform(
        "_cues",
        lambda c, i: F.struct(
            c["start_ms"].alias("start_ms"),
            c["end_ms"].alias("end_ms"),
            c["text"].alias("text"),
            F.when(c["start_ms"].isNull(), F.lit("no timing line"))
            .when(c["start_ms"] < F.when(i > 0, F.get("_cues", i - 1)["end_ms"]).otherwise(F.col("_end")), F.lit("regressing cue"))
            .when(is_blank(c["text"]), F.lit("empty text"))
            .alias("error"),
        ),
    )
    broken = F.struct(
        F.lit(None).cast("bigint").alias("start_ms"),
        F.lit(None).cast("bigint").alias("end_ms"),
        F.lit(None).cast("string").alias("text"),
        F.lit("no WEBVTT header").alias("error"),
    )
    if "part_no" in keys:
        # Of a document without header, the first part alone says so.
        unread = F.when(F.col("part_no") == 0, F.array(broken)).otherwise(F.slice(F.array(broken), 1, 0))
        cues, broken_row = F.when(F.col("_whole"), cues).otherwise(unread), F.lit(True)
    else:
        broken_row = F.col("_header")
    rows = rows.select(*keys, "_n", F.posexplode(F.when(broken_row, cues).otherwise(F.array(broken))).alias("_i", "c"))
    return rows.select(*keys, (F.col("_n") + F.col("_i") + 1).cast("bigint").alias("cue_no"), "c.start_ms", "c.end_ms", "c.text", "c.error")


def _before_parts(rows: DataFrame) -> DataFrame:
    """For each part: cues before it, the end of the last of them, and whether the document has its header."""
    keys = ["file_id", "part_no"]
    n = F.size("_cues").cast("bigint")
    parts = rows.select(*keys, "_header", n.alias("_size"), F.get("_cues", F.size("_cues") - 1)["end_ms"].alias("_last"))
    earlier = Window.partitionBy("file_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_size") > 0, F.struct("_last")), ignorenulls=True).over(earlier)
    return parts.select(
        *keys,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).cast("bigint").alias("_n"),
        last["_last"].alias("_end"),
        F.min("_header").over(Window.partitionBy("file_id")).alias("_whole"),
    )


def document_errors(parsed: DataFrame) -> DataFrame:
    """The first error of each document that has one."""
    order = [c for c in ("part_no", "cue_no") if c in parsed.columns]
    bad = parsed.filter("error IS NOT NULL")
    return bad.groupBy("file_id").agg(F.min_by("error", F.struct(*order)).alias("error"))


def regressing_cues(cues: DataFrame, block_size: int | None = None) -> DataFrame:
    """Cues that start before the one before them ends."""
    rows, block = blocked_by(cues, ["file_id"], block_of(F.col("cue_no"), block_size or BLOCK), force=bool(block_size))
    rows = previous_row(rows, ["file_id"], block, ["cue_no"], ["end_ms"], "_prev")
    return rows.filter(F.col("start_ms") < F.col("_prev.end_ms")).select("file_id", "cue_no", "start_ms", F.col("_prev.end_ms").alias("previous_end_ms"))


def cue_intervals(cues: DataFrame) -> DataFrame:
    """Cues as an interval table in samples."""
    return cues.select(
        "file_id",
        F.col("cue_no").alias("idx"),
        ms_to_samples(F.col("start_ms")).alias("start_sample"),
        ms_to_samples(F.col("end_ms")).alias("end_sample"),
    )


