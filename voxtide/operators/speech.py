"""Speech detection over scored frames: latch, islands, splitting, padding, merging.

With fixed thresholds everything is windows and joins. Only the two rules with a running state go through
``blocked_fold``: the adaptive noise floor, and the cutting or merging of stretches that exceed the maximum length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from voxtide.functions.timecode import int_div
from voxtide.operators.folds import Step, blocked_fold
from voxtide.operators.frames import classify
from voxtide.operators.ordered import (
    BLOCK,
    block_of,
    fits_one_task,
    local_window,
    next_row,
    previous_row,
    row_index,
    running_last,
    running_max,
    running_sum,
    settle,
    with_halo,
)
from voxtide.operators.scanner import FORCED, NATURAL, TAIL, FrameScan, Merger
from voxtide.options import DetectorOptions
from voxtide.session import cut_lineage

# A maximum length from here up means that nothing is ever cut; the plan then stays free of eager steps.
NO_CAP = 1 << 60
# Frames per task of the adaptive scan: almost an hour and a half of audio.
SCAN_BLOCK = 1 << 18

PIECES = StructType(
    [
        StructField("island", LongType()),
        StructField("k", LongType()),
        StructField("start_sample", LongType()),
        StructField("end_sample", LongType()),
        StructField("kind", StringType()),
    ]
)


def _edge_marks(frames: DataFrame, options: DetectorOptions, block_size: int | None) -> tuple[DataFrame, str | None]:
    """Frames with ``_on`` where a loud run reaches the onset length and ``_off`` where a quiet run the silence length.

    A look-back over that many frames decides both, so each block only needs a halo of the frames before it.
    """
    seg = options.segmenter
    n, k = seg.onset_frames, seg.silence_frames
    block = None
    if block_size:
        block = "_b"
        rows = with_halo(frames, "frame_idx", block, block_size, max(n, k))
    else:
        rows = frames.withColumn("halo", F.lit(False))
    w = local_window(["file_id"], block, ["frame_idx"])

    def reaches(flag: str, count: int):
        full = F.sum(F.col(flag).cast("int")).over(w.rowsBetween(1 - count, 0)) == count
        return full & ~F.coalesce(F.lag(flag, count).over(w), F.lit(False))

    marked = rows.select(
        "*",
        reaches("above", n).alias("_on"),
        reaches("below", k).alias("_off"),
        F.lag("start_sample", n - 1).over(w).alias("core_start"),
        F.lag("end_sample", k).over(w).alias("voiced_end"),
    )
    return marked, block


def latch_edges(frames: DataFrame, options: DetectorOptions, block_size: int | None = None) -> DataFrame:
    """The marked frames alone.

    They carry the first sample of the loud run and the end of the last frame before the quiet run; on the plain plan
    also the recording's end, its last frame that is not quiet, and its last index.
    """
    rows = frames.select("file_id", "frame_idx", "start_sample", "end_sample", "above", "below")
    marked, block = _edge_marks(rows, options, block_size)
    if block is None:
        marked = marked.select("*", *[c.over(Window.partitionBy("file_id")).alias(name) for name, c in _file_ends().items()])
    kept = list(_file_ends()) if block is None else [block]
    return marked.filter("NOT halo AND (_on OR _off)").select(
        "file_id", "frame_idx", F.col("_on").alias("on"), "core_start", "voiced_end", "end_sample", *kept
    )


def _file_ends() -> dict:
    return {
        "_total": F.max("end_sample"),
        "_voiced": F.max(F.when(~F.col("below"), F.col("end_sample"))),
        "_last": F.max("frame_idx"),
    }


def latch(frames: DataFrame, options: DetectorOptions, block_size: int | None = None) -> DataFrame:
    """Speech state after every frame (frames need ``above`` and ``below``)."""
    marked, block = _edge_marks(frames, options, block_size)
    marked = marked.filter("NOT halo").drop("halo", "core_start", "voiced_end")
    event = F.when(F.col("_on"), F.lit(True)).when(F.col("_off"), F.lit(False))
    rows = running_last(settle(marked, block), ["file_id"], block, ["frame_idx"], event, "_state")
    return rows.withColumn("in_speech", F.coalesce("_state", F.lit(False))).drop("_b", "_on", "_off", "_state")


def islands(frames: DataFrame, options: DetectorOptions, block_size: int | None = None) -> DataFrame:
    """Stretches of speech: core start, end of the last frame that was not quiet, and the sample of closing."""
    key, order, block = ["file_id"], ["frame_idx"], "_b" if block_size else None
    edges = settle(latch_edges(frames, options, block_size), block)
    edges = previous_row(edges, key, block, order, ["on"], "_prev")
    toggles = edges.filter(F.col("on") != F.coalesce(F.col("_prev.on"), F.lit(False))).drop("_prev")
    rows = next_row(toggles, key, block, order, ["frame_idx", "voiced_end", "end_sample"], "_close").filter("on")
    if block_size:
        rows = rows.join(frames.groupBy("file_id").agg(*[c.alias(n) for n, c in _file_ends().items()]), "file_id")
    return rows.select(
        "file_id",
        F.col("core_start"),
        F.coalesce("_close.voiced_end", "_voiced").alias("voiced_end"),
        F.coalesce("_close.end_sample", "_total").alias("close_sample"),
        F.coalesce("_close.frame_idx", "_last").alias("close_idx"),
        F.col("_close").isNotNull().alias("closed"),
    )


def _padded(rows: DataFrame, options: DetectorOptions) -> DataFrame:
    seg = options.segmenter
    return rows.withColumn("_begin", F.greatest(F.col("core_start") - seg.pre_roll, F.lit(0))).withColumn(
        "_end", F.least(F.col("close_sample"), F.col("voiced_end") + seg.post_roll)
    )


def _over_long(options: DetectorOptions):
    return F.col("_end") > F.col("_begin") + options.segmenter.max_segment


def natural_pieces(stretches: DataFrame, options: DetectorOptions) -> DataFrame:
    """Padded pieces of the stretches that need no cut, short speech dropped."""
    rows = _padded(stretches, options)
    keep = ~_over_long(options) & (F.col("_end") > F.col("_begin"))
    keep = keep & (F.col("voiced_end") - F.col("core_start") >= options.segmenter.min_speech)
    return rows.filter(keep).select(
        "file_id",
        F.col("core_start").alias("island"),
        F.lit(0).cast("bigint").alias("k"),
        F.col("_begin").alias("start_sample"),
        F.col("_end").alias("end_sample"),
        F.lit(NATURAL).alias("kind"),
    )


def _fixed_step(options: DetectorOptions):
    def step(block: dict[str, list], state, last: bool):
        scan = FrameScan(options, state)
        scan.feed(*(block[c] for c in _FIXED_COLUMNS))
        if last:
            scan.finish()
        return scan.pieces, scan.state()

    return step


_FIXED_COLUMNS = ["start_sample", "end_sample", "dbfs", "above", "below"]


def scanned_pieces(frames: DataFrame, options: DetectorOptions) -> DataFrame:
    """All pieces from one ordered pass over frames that are classified already."""
    return blocked_fold(frames, ["file_id"], None, ["frame_idx"], PIECES, _fixed_step(options), _FIXED_COLUMNS)


def split_pieces(frames: DataFrame, stretches: DataFrame, options: DetectorOptions, block_size: int = SCAN_BLOCK) -> DataFrame:
    """Pieces of the over-long stretches, cut at the quietest frame near each limit.

    Only frames of such stretches are read back: they are found by (file, block), so a long recording stays divided.
    """
    frame = options.frame_samples
    long = _padded(stretches, options).filter(_over_long(options))
    first = F.greatest(int_div(F.col("core_start"), frame), F.lit(0))
    spans = long.select(
        "file_id",
        F.col("core_start").alias("_island"),
        "close_idx",
        F.explode(F.sequence(int_div(first, block_size), int_div(F.col("close_idx"), block_size))).alias("_b"),
    )
    rows = frames.withColumn("_b", block_of(F.col("frame_idx"), block_size)).join(spans, ["file_id", "_b"])
    rows = rows.filter((F.col("start_sample") >= F.col("_island")) & (F.col("frame_idx") <= F.col("close_idx")))
    keys = ["file_id", "_island"]
    return blocked_fold(rows, keys, "_b", ["frame_idx"], PIECES, _fixed_step(options), _FIXED_COLUMNS).drop("_island")


def adaptive_pieces(frames: DataFrame, options: DetectorOptions, block_size: int | None = None) -> DataFrame:
    """Pieces found with the noise floor following the quiet frames."""

    def step(block: dict[str, list], state, last: bool):
        scan = FrameScan(options, state)
        scan.feed(*(block[c] for c in ("start_sample", "end_sample", "dbfs")))
        if last:
            scan.finish()
        return scan.pieces, scan.state()

    rows, block = frames, None
    if block_size:
        rows, block = frames.withColumn("_b", block_of(F.col("frame_idx"), block_size)), "_b"
    return blocked_fold(rows, ["file_id"], block, ["frame_idx"], PIECES, step, ["start_sample", "end_sample", "dbfs"])


def merge_pieces(pieces: DataFrame, options: DetectorOptions, block_samples: int | None = None) -> DataFrame:
    """Final intervals ``file_id, start_sample, end_sample``.

    A piece starts a new chain where it cannot merge with what came before whatever the lengths; a chain within the
    maximum length becomes one interval by plain aggregation, and only longer chains are folded in order.
    """
    seg = options.segmenter
    key, order = ["file_id"], ["island", "k"]
    capped = seg.max_segment < NO_CAP
    rows, block = pieces, None
    if block_samples:
        rows, block = pieces.withColumn("_b", int_div(F.col("island"), block_samples)), "_b"
    rows = running_max(settle(rows, block), key, block, order, F.col("end_sample"), "_upto", inclusive=False)
    begin = F.greatest("start_sample", "_upto")
    empty = F.col("end_sample") <= F.coalesce("_upto", F.lit(-1))
    failed = None
    if options.forced_piece_can_fail and capped:
        failed = rows.filter((F.col("kind") == FORCED) & empty).select("file_id").distinct()
    rows = rows.filter(~(F.col("kind").isin(FORCED, TAIL) & empty))
    fresh = (F.col("kind") != NATURAL) | F.col("_upto").isNull() | (F.col("start_sample") > F.col("_upto") + seg.merge_gap)
    rows = rows.withColumn("_fresh", fresh).withColumn("start_sample", F.when(F.col("_fresh"), begin).otherwise(F.col("start_sample")))
    rows = running_sum(rows, key, block, order, F.col("_fresh").cast("bigint"), "_chain")
    if not capped:
        return _plain_chains(rows, order).select("file_id", "start_sample", "end_sample")
    result = _short_and_long_chains(rows, order, options, block)
    return result if failed is None else result.join(failed, "file_id", "left_anti")


def _plain_chains(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.groupBy("file_id", "_chain").agg(
        F.min_by("start_sample", F.struct(*order)).alias("start_sample"), F.max("end_sample").alias("end_sample")
    )


def _short_and_long_chains(rows: DataFrame, order: list[str], options: DetectorOptions, block: str | None) -> DataFrame:
    if block is None:
        return _fold_chains(rows, options, None)
    chains = _plain_chains(rows, order)
    fits = F.col("end_sample") - F.col("start_sample") <= options.segmenter.max_segment
    result = chains.filter(fits).select("file_id", "start_sample", "end_sample")
    long = cut_lineage(chains.filter(~fits).select("file_id", "_chain"))
    if long.isEmpty():
        return result
    return result.unionByName(_fold_chains(rows.join(long, ["file_id", "_chain"]), options, block))


def _fold_chains(rows: DataFrame, options: DetectorOptions, block: str | None) -> DataFrame:
    def step(block: dict[str, list], state, last: bool):
        merger = Merger(options, state)
        for start, end, kind in zip(block["start_sample"], block["end_sample"], block["kind"]):
            merger.add(start, end, kind)
        held = merger.previous
        if last:
            merger.flush()
        return merger.done, held

    output = StructType([StructField("start_sample", LongType()), StructField("end_sample", LongType())])
    keys = ["file_id", "_chain"] if block else ["file_id"]
    folded = blocked_fold(rows, keys, block, ["island", "k"], output, step, ["start_sample", "end_sample", "kind"])
    return folded.select("file_id", "start_sample", "end_sample")


def detect_with(frames: DataFrame, step: Step, columns: list[str]) -> DataFrame:
    """Hook for another detector: ``step`` gets a recording's frames in order, as ``blocked_fold`` describes, and emits
    ``(start_sample, end_sample)`` pairs."""
    output = StructType([StructField("start_sample", LongType()), StructField("end_sample", LongType())])
    return blocked_fold(frames, ["file_id"], None, ["frame_idx"], output, step, columns)


def failed_files(pieces: DataFrame, options: DetectorOptions, block_samples: int | None = None) -> DataFrame:
    """Files whose forced pieces vanish behind an earlier interval; such a recording counts as failed."""
    rows, block = pieces, None
    if block_samples:
        rows, block = pieces.withColumn("_b", int_div(F.col("island"), block_samples)), "_b"
    rows = running_max(rows, ["file_id"], block, ["island", "k"], F.col("end_sample"), "_upto", inclusive=False)
    lost = (F.col("kind") == FORCED) & (F.col("end_sample") <= F.col("_upto"))
    return rows.filter(lost).select("file_id", F.lit("a maximum-length split produced an empty interval").alias("error")).distinct()


def numbered(intervals: DataFrame, block_samples: int | None = None) -> DataFrame:
    """Adds ``idx``, the position within the file."""
    rows, block = intervals, None
    if block_samples:
        rows, block = intervals.withColumn("_b", int_div(F.col("start_sample"), block_samples)), "_b"
    return row_index(rows, ["file_id"], block, ["start_sample"], "idx").drop("_b")


def speech_pieces(frames: DataFrame, options: DetectorOptions, adaptive: bool = True, block_size: int | None = None) -> DataFrame:
    if adaptive:
        return adaptive_pieces(frames, options, block_size)
    marked = frames if "above" in frames.columns else classify(frames, options)
    if options.segmenter.max_segment >= NO_CAP:
        return natural_pieces(islands(marked, options, block_size), options)
    if not block_size:
        # One scan of each recording reads the frames once; windows with a join back for the cuts read them twice.
        return scanned_pieces(marked, options)
    stretches = cut_lineage(islands(marked, options, block_size))
    pieces = natural_pieces(stretches, options)
    if _padded(stretches, options).filter(_over_long(options)).isEmpty():
        return pieces
    return pieces.unionByName(split_pieces(marked, stretches, options, block_size))


def detect_speech(
    frames: DataFrame,
    options: DetectorOptions | None = None,
    adaptive: bool = True,
    block_size: int | None = None,
) -> DataFrame:
    """Speech intervals ``file_id, start_sample, end_sample`` of every recording.

    With ``block_size`` frames per block a recording may be spread over many tasks; by default that happens only where
    some recording is too long for one.
    """
    options = options or DetectorOptions()
    if block_size is None and not fits_one_task(frames, ["file_id"]):
        block_size = SCAN_BLOCK if adaptive else BLOCK
    pieces = speech_pieces(frames, options, adaptive, block_size)
    return merge_pieces(pieces, options, block_size and block_size * options.frame_samples)
