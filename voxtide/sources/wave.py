"""WAVE recordings: layouts from prefixes, frames and intervals by byte range, and a data source of PCM blocks.

Recordings are addressed by path. Every operator reads in its own task what it needs, so no row ever holds a file,
files may have any size, and a long recording is spread over many tasks.
"""

from __future__ import annotations

import posixpath
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from voxtide.operators.frames import FRAME_SCHEMA, score_pcm
from voxtide.session import ship_package
from voxtide.sources.ranges import BadWave, Decoder, Opener, Recording, entries, file_system, frames_per_read, gathered, problem_of, read_layout, read_range

_LAYOUT = (
    "sample_rate int, channels smallint, bits smallint, block_align smallint, "
    "data_offset bigint, data_length bigint, sample_count bigint, error string"
)
_SCAN = "path string, " + _LAYOUT
_NAMES = [field.split()[0] for field in _SCAN.split(", ")]
# Bytes of audio that one task reads.
TASK_BYTES = 64 << 20
# Recordings whose headers one task reads.
TASK_FILES = 4_096
# Tasks among which a folder's ranges are dealt, while that gives none more than TASK_BYTES or less than LEAST_BYTES.
FOLDER_TASKS, LEAST_BYTES = 1_024, 1 << 20


def _layout_row(path: str, opener: Opener) -> tuple:
    try:
        found = read_layout(opener(path))
        return (path, *found, found[5] // found[3], None)
    except Exception as problem:
        return (path, *[None] * 7, problem_of(problem))


def scan_wave(files: DataFrame, decoder: Decoder | None = None) -> DataFrame:
    """One row per file of ``files(path)``: its layout, or the one reason why it is no usable recording.

    Of each file the header and eight bytes a chunk are read, wherever the chunks lie. A file that is missing or
    cannot be opened has that as its reason. With a ``decoder``, files are decoded as a whole to be looked at, and a
    failure of the decoder is the reason. Null paths are dropped; a repeated path gives a row each time.
    """

    ship_package(files.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = Opener(decoder)
        for batch in batches:
            yield pd.DataFrame([_layout_row(path, opener) for path in batch["path"]], columns=_NAMES, dtype=object)
        opener.close()

    return files.select("path").filter("path IS NOT NULL").mapInPandas(scan, _SCAN)


def spread(rows: DataFrame, size: Column, task_bytes: int, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as their bytes ask for, equal ``keys`` to one task.

    The rows are a few numbers each, so their own size says nothing of the work behind them.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    most = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(most, -(-int(total) // task_bytes)), *keys)


def byte_ranges(layouts: DataFrame, frame: int = 320, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The data of usable recordings in ranges that begin on a frame: ``file_id, at, length, first_sample``."""
    size = max(1, task_bytes // (2 * frame)) * 2 * frame
    rows = layouts.filter("error IS NULL AND data_length > 0")
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("data_length") - 1, F.lit(size).cast("bigint")))
    rows = rows.select(F.col("path").alias("file_id"), "data_offset", "data_length", begin.alias("_begin"))
    return rows.select(
        "file_id",
        (F.col("data_offset") + F.col("_begin")).alias("at"),
        F.least(F.lit(size).cast("bigint"), F.col("data_length") - F.col("_begin")).alias("length"),
        F.expr("_begin div 2").alias("first_sample"),
    )


_SCORED = f"file_id string, {FRAME_SCHEMA}, error string"
_SCORED_NAMES = [field.split()[0] for field in _SCORED.split(", ")]


def _scored(file_id: str, first: int, pcm: bytes, frame: int) -> pa.RecordBatch:
    columns = score_pcm(pcm, first, frame)
    count = len(columns[0])
    ids, errors = pa.array([file_id] * count, pa.string()), pa.nulls(count, pa.string())
    return pa.RecordBatch.from_arrays([ids, *columns, errors], _SCORED_NAMES)


def _failure(file_id: str, problem: Exception) -> pa.RecordBatch:
    numbers = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([file_id]), *numbers, pa.array([problem_of(problem)])], _SCORED_NAMES)


def scan_frames(layouts: DataFrame, frame: int = 320, task_bytes: int = TASK_BYTES, decoder: Decoder | None = None) -> DataFrame:
    """Scored frames of usable recordings, read and reduced to levels in one task: ``file_id``, the frame's columns,
    ``error``. A recording that fails while it is read has a row with an ``error`` and no frame beside the others.

    With a ``decoder``, which knows whole files only, a recording is one task's.
    """
    ranges = byte_ranges(layouts, frame, task_bytes)
    ranges = spread(ranges, F.col("length"), task_bytes, *(["file_id"] if decoder else ["file_id", "at"])).sortWithinPartitions("file_id", "at")
    step = frames_per_read(2 * frame)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = Opener(decoder)
        for batch in batches:
            for file_id, at, length, first in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    for done, pcm in read_range(opener(file_id), at, length, step):
                        yield _scored(file_id, first + done // 2, pcm, frame)
                except Exception as problem:
                    yield _failure(file_id, problem)
        opener.close()

    return ranges.mapInArrow(score, _SCORED)


def interval_ranges(intervals: DataFrame, layouts: DataFrame, task_bytes: int = TASK_BYTES, whole: bool = False) -> DataFrame:
    """Where the samples of each interval lie: ``intervals(file_id, idx, start_sample, end_sample)`` and ``path, at,
    length``, dealt to tasks by their bytes, a file's next to each other. Only numbers are joined and shuffled. With
    ``whole``, a file's intervals come to one task."""
    places = layouts.filter("error IS NULL").select(F.col("path").alias("file_id"), "data_offset")
    rows = intervals.join(places, "file_id").select(
        "file_id",
        "idx",
        "start_sample",
        "end_sample",
        F.col("file_id").alias("path"),
        (F.col("data_offset") + 2 * F.col("start_sample")).alias("at"),
        (2 * (F.col("end_sample") - F.col("start_sample"))).alias("length"),
    )
    # Neighbours within a task's worth of audio stay together, so that a file is not opened for each of them.
    rows = rows.withColumn("_near", F.lit(0) if whole else F.expr(f"at div {task_bytes}"))
    return spread(rows, F.col("length"), task_bytes, "path", "_near").sortWithinPartitions("path", "at").drop("_near")


def data_hashes(layouts: DataFrame) -> DataFrame:
    """SHA-256 of the PCM data alone, read in pieces: ``path, pcm_sha, error``."""
    rows = layouts.filter("error IS NULL").select("path", "data_offset", "data_length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        opener = Opener()
        for batch in batches:
            out = []
            for path, at, length in zip(batch["path"], batch["data_offset"], batch["data_length"]):
                try:
                    found = sha256()
                    for _, piece in read_range(opener(path), int(at), int(length)):
                        found.update(piece)
                    out.append((path, found.hexdigest().upper(), None))
                except Exception as problem:
                    out.append((path, None, problem_of(problem)))
            yield pd.DataFrame(out, columns=["path", "pcm_sha", "error"], dtype=object)
        opener.close()

    return spread(rows, F.col("data_length"), TASK_BYTES, "path").mapInPandas(digest, "path string, pcm_sha string, error string")


@dataclass
class ByteRange(InputPartition):
    """Part of a folder's audio: stretches of files, each with the file's size, that are read in ranges of ``split`` bytes
    from their begin. Names and numbers are packed, as the driver holds those of the whole folder."""

    names: str
    numbers: bytes
    split: int

    def __init__(self, spans: Sequence[tuple[str, int, int, int]], split: int):
        self.names = "\0".join(name for name, *_ in spans)
        self.numbers = array("q", [n for _, *numbers in spans for n in numbers]).tobytes()
        self.split = split

    def ranges(self) -> Iterator[tuple[str, int, int, int]]:
        """Files, their sizes, and the file bytes from ``begin`` up to ``end`` of each."""
        numbers = array("q", self.numbers)
        for k, name in enumerate(self.names.split("\0")):
            size, begin, end = numbers[3 * k : 3 * k + 3]
            for at in range(begin, max(end, begin + 1), self.split):
                yield name, size, at, min(at + self.split, end)

    @property
    def parts(self) -> tuple[tuple[str, int, int, int], ...]:
        return tuple(self.ranges())


def plan_ranges(files: Iterable[tuple[str, int]], split: int, task: int | None = None) -> list[ByteRange]:
    """Files cut every ``split`` bytes, ranges packed together up to ``task`` bytes (``split`` without it): sizes are all it
    needs. The ranges themselves are cut where they are read, so a plan is as long as the list of files, however short they are."""
    task = split if task is None else max(split, task)
    planned, here, room = [], [], task
    for path, size in files:
        at, left = 0, True
        while left:
            if here and min(split, size - at) > room:
                planned.append(ByteRange(here, split))
                here, room = [], task
            # All that is left of the file, or as many whole ranges as there is room for.
            end = size if size - at <= room else at + room // split * split
            here.append((path, size, at, end))
            room, at, left = room - (end - at), end, end < size
    return planned + ([ByteRange(here, split)] if here else [])


def blocks_of(
    recording: Recording, begin: int, end: int, frame_bytes: int, layout: tuple[int, ...] | None = None
) -> Iterator[tuple[int, bytes]]:
    """Blocks of whole frames that begin at file bytes from ``begin`` up to ``end``: first sample and PCM. The ``layout``
    is read where it is not given.

    The frame that straddles an edge belongs to the range that it begins in, so ranges side by side have every
    frame once; only a recording's last frame may be short.
    """
    *_, offset, length = layout or read_layout(recording)
    low, high = (min(max(-(-(at - offset) // frame_bytes) * frame_bytes, 0), length) for at in (begin, end))
    for done, pcm in read_range(recording, offset + low, high - low, frames_per_read(frame_bytes)):
        yield (low + done) // 2, pcm


def _files(system: Any, root: str) -> Iterator[tuple[str, int]]:
    """Every file below a folder and its size."""
    if not isinstance(system, pafs.LocalFileSystem):
        yield from ((f.path, f.size) for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file)
        return
    folders = [root]
    while folders:
        for path, folder, size in entries(system, folders.pop(), lambda _: True):
            if folder:
                folders.append(path)
            else:
                yield path, size


_BLOCK = pa.schema([("path", pa.string()), ("first_sample", pa.int64()), ("pcm", pa.binary()), ("error", pa.string())])


class PcmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extension = options.get("extension", "wav").lower()
        self.frame_bytes = 2 * int(options.get("frameSamples", 320))
        self.split = int(options.get("splitBytes", TASK_BYTES))
        if self.frame_bytes <= 0 or self.split <= 0:
            raise ValueError("frameSamples and splitBytes are positive")

    def partitions(self) -> list[ByteRange]:
        system, root = file_system(self.root)
        below, ending = root.rstrip("/") + "/", "." + self.extension
        names, sizes = [], array("q")
        for path, size in _files(system, root):
            if path.lower().endswith(ending):
                names.append(path.removeprefix(below))
                sizes.append(size)
        # Ranges may be short, but neither a small nor a large folder gets a task for each.
        return plan_ranges(zip(names, sizes), self.split, min(TASK_BYTES, max(LEAST_BYTES, sum(sizes) // FOLDER_TASKS)))

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return gathered(self._blocks(partition), _BLOCK)

    def _blocks(self, partition: ByteRange) -> Iterator[tuple]:
        system, root = file_system(self.root)
        opener = Opener(opened=system.open_input_file)
        known, layout = None, None
        for name, _, begin, end in partition.ranges() if partition else ():
            path = posixpath.join(root, name)
            try:
                recording = opener(path)
                if recording is not known:
                    layout, known = read_layout(recording), recording
                for first, pcm in blocks_of(recording, begin, end, self.frame_bytes, layout):
                    yield path, first, pcm, None
            except (BadWave, OSError) as problem:
                # Each range of a broken file meets the problem; the first of them reports it.
                if begin == 0:
                    yield path, None, None, problem_of(problem)
        opener.close()


class PcmSource(DataSource):
    """``spark.read.format("wave-pcm").load(folder)``: PCM blocks of the recordings below a folder.

    Partitions are packed byte ranges, planned from a listing as Spark plans its own files; each reads its recording's header
    and the frames that begin in its range. Columns ``path, first_sample, pcm, error``; a file that is no usable recording is one
    row with an ``error``. Options: ``frameSamples`` (320), ``splitBytes`` (64 MiB), ``extension`` (``wav``, any case).
    """

    @classmethod
    def name(cls) -> str:
        return "wave-pcm"

    def schema(self) -> str:
        return "path string, first_sample bigint, pcm binary, error string"

    def reader(self, schema: StructType) -> PcmReader:
        return PcmReader(self.options)


def read_pcm(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The folder's PCM blocks, with the data source registered in the session."""
    ship_package(spark)
    spark.dataSource.register(PcmSource)
    return spark.read.format("wave-pcm").options(**options).load(folder)
