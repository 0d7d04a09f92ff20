"""Samples to scored frames, and frame checks.

Frame tables have ``file_id, frame_idx, start_sample, end_sample, dbfs``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.scalars import FULL_SCALE, classify_frame, dbfs_from_rms
from voxtide.functions.timecode import int_div
from voxtide.operators.ordered import BLOCK, block_of, blocked_by, previous_row
from voxtide.options import DetectorOptions
from voxtide.sources.ranges import READ_BYTES


def frame_samples(samples: DataFrame, frame: int = 320) -> DataFrame:
    """Frames from one row per sample ``(file_id, idx, s)``: sizes and energy in one aggregation.

    The sum of squares is exact in 64 bits, so the result does not depend on the order of addition.
    """
    s = F.col("s").cast("bigint")
    grouped = samples.groupBy("file_id", int_div(F.col("idx"), frame).alias("frame_idx")).agg(
        F.min("idx").alias("start_sample"),
        (F.max("idx") + 1).alias("end_sample"),
        F.sum(s * s).alias("_squares"),
        F.count("s").alias("_n"),
    )
    rms = F.sqrt(F.col("_squares") / F.col("_n"))
    return grouped.select("file_id", "frame_idx", "start_sample", "end_sample", rms.alias("rms")).withColumn(
        "dbfs", dbfs_from_rms(F.col("rms"))
    )


FRAME_SCHEMA = "frame_idx bigint, start_sample bigint, end_sample bigint, rms double, dbfs double"


def score_blocks(blocks: Sequence[bytes], firsts: Sequence[int], frame: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Which block each frame is of, and the columns of ``FRAME_SCHEMA``, for blocks as ``score_pcm`` takes one."""
    squares = np.frombuffer(b"".join(blocks), dtype="<i2").astype(np.int64) ** 2
    counts = np.array([len(pcm) // 2 for pcm in blocks], np.int64)
    frames = -(-counts // frame)
    of = np.repeat(np.arange(len(blocks)), frames)
    within = (np.arange(of.size) - np.repeat(np.cumsum(frames) - frames, frames)) * frame
    sizes = np.minimum(frame, counts[of] - within)
    cuts = within + (np.cumsum(counts) - counts)[of]
    rms = np.sqrt(np.add.reduceat(squares, cuts) / sizes) if squares.size else np.empty(0)
    with np.errstate(divide="ignore"):
        dbfs = np.where(rms > 0, 20.0 * np.log10(rms / FULL_SCALE), -np.inf)
    start = np.array(firsts, np.int64)[of] + within
    return of, [pa.array(start // frame), pa.array(start), pa.array(start + sizes), pa.array(rms), pa.array(dbfs)]


def _check_block(pcm: bytes, first: int, frame: int) -> None:
    if len(pcm) % 2:
        raise ValueError("PCM block has an odd byte count")
    if first % frame:
        raise ValueError("PCM block does not begin on a frame boundary")


def score_pcm(pcm: bytes, first: int, frame: int) -> list[pa.Array]:
    """The columns of ``FRAME_SCHEMA`` for little-endian 16-bit mono samples that begin at sample ``first``.

    ``first`` is a frame's; only the last frame may be short. An odd byte count is an error.
    """
    _check_block(pcm, first, frame)
    return score_blocks([pcm], [first], frame)[1]


def frame_blocks(blocks: DataFrame, frame: int = 320) -> DataFrame:
    """Frames from PCM blocks ``(file_id, first_sample, pcm)`` of little-endian 16-bit mono samples.

    Blocks must begin on a frame boundary; only the last block of a file may end off one. An odd byte count fails.
    """
    names = ["file_id", "frame_idx", "start_sample", "end_sample", "rms", "dbfs"]

    def scored(ids: pa.Array, begin: int, pcms: list[bytes], firsts: list[int]) -> pa.RecordBatch:
        of, columns = score_blocks(pcms, firsts, frame)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(begin + of)), *columns], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begin, pcms, firsts, size = batch.column(0), 0, [], [], 0
            for row, first in enumerate(batch.column(1).to_pylist()):
                pcm = batch.column(2)[row].as_py()
                try:
                    _check_block(pcm, first, frame)
                except ValueError as problem:
                    raise ValueError(f"file {ids[row].as_py()}: {problem}") from problem
                if pcms and size + len(pcm) > READ_BYTES:
                    yield scored(ids, begin, pcms, firsts)
                    begin, pcms, firsts, size = row, [], [], 0
                pcms.append(pcm)
                firsts.append(first)
                size += len(pcm)
            if pcms:
                yield scored(ids, begin, pcms, firsts)

    kind = blocks.schema["file_id"].dataType.simpleString()
    return blocks.select("file_id", "first_sample", "pcm").mapInArrow(score, f"file_id {kind}, {FRAME_SCHEMA}")


def check_frames(frames: DataFrame, block_size: int | None = None) -> DataFrame:
    """Violations: frames that do not follow each other without gap, are empty, or have an impossible level."""
    rows, block = blocked_by(frames, ["file_id"], block_of(F.col("frame_idx"), block_size or BLOCK), force=bool(block_size))
    rows = previous_row(rows, ["file_id"], block, ["frame_idx"], ["end_sample"], "_prev")
    expected = F.coalesce(F.col("_prev.end_sample"), F.lit(0))
    rule = (
        F.when(F.col("end_sample") <= F.col("start_sample"), F.lit("empty"))
        .when(F.col("start_sample") != expected, F.lit("contiguity"))
        .when(F.col("dbfs").isNull() | F.isnan("dbfs") | (F.col("dbfs") == float("inf")), F.lit("level"))
    )
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select("file_id", "frame_idx", "rule")


def classify(frames: DataFrame, options: DetectorOptions) -> DataFrame:
    """Adds ``above`` and ``below`` against thresholds that stay at the initial noise floor."""
    above, below = classify_frame(F.col("dbfs"), F.lit(options.initial_floor), options)
    return frames.withColumn("above", above).withColumn("below", below)
