"""Ordered per-key processing on streams, with typed state.

Rows of a key may arrive out of order across micro-batches: each key keeps the position it expects next, and rows
ahead of it wait, sorted and in blocks, so that the state is asked once for many rows. What waits is what is missing, so
state stays small on an orderly stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from voxtide.operators.jobs import PENDING, TERMINAL, TRANSCRIBING
from voxtide.operators.scanner import FrameScan, Merger
from voxtide.options import DetectorOptions
from voxtide.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# How long a key that ended is remembered, so that late repeats of its rows are known for what they are.
REMEMBER_MS = 24 * 3_600_000
# Rows that are handed on at once.
TAKEN = 1_024
# Waiting rows, and their characters, in one block of the state; and rows of a micro-batch that are sorted together.
BLOCK_ROWS, BLOCK_CHARS = 1_024, 1 << 20
RUN_ROWS, RUN_CHARS = 65_536, 16 << 20
# Characters of a transcript in one value of the state and one row of the result.
PART_CHARS = 4_096


def _chars(rows: Any) -> int:
    return sum(len(v) for row in rows for v in row if isinstance(v, str))


class Ordered(StatefulProcessor):
    """A key's rows in the order of ``position``, from 0 on: subclasses say what they keep and what they emit.

    ``idle_ms`` ends a key of which no row came for that long (processing time); without it only the rows do.
    """

    output = ""
    columns: tuple[str, ...] = ()

    def __init__(self, key: str, position: str, row_schema: str, idle_ms: int | None, remember_ms: int):
        self.key, self.position_name, self.row_schema = key, position, row_schema
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Creates the subclass's own state."""

    def following(self, row: tuple) -> int:
        return row[0] + 1

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        """Output of rows that are due; sets ``self.done`` when the key ended."""
        raise NotImplementedError

    def finish(self, waiting: int) -> Iterator[tuple]:
        """Output of a key that is ended from outside while ``waiting`` rows never became due."""
        return iter(())

    def forget(self) -> None:
        """Clears the subclass's own state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [field.dataType.simpleString() for field in self.row_schema]
        self.floats = [kind in ("float", "double") for kind in kinds]
        held = ", ".join(f"c{n} array<{kind}>" for n, kind in enumerate(kinds))
        # What waits is in sorted blocks, of which the first position is known here; as few rows as one block has lie here.
        self.place = handle.getValueState("place", f"upto bigint, waiting bigint, made bigint, firsts array<bigint>, numbers array<bigint>, {held}")
        self.early = handle.getMapState("early", "number bigint", held)
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=self.remember_ms)
        self.open(handle)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [self.key, *(field.split()[0] for field in self.output.split(", "))]
        return pd.DataFrame([(key[0], *row) for row in rows], columns=names, dtype=object)

    def _columns(self, rows: list[tuple]) -> tuple[list, ...]:
        """Rows as the state holds them; what is missing in a column of whole numbers comes as NaN."""
        columns = zip(*rows) if rows else ([] for _ in self.floats)
        return tuple(list(c) if real else [None if v != v else v for v in c] for c, real in zip(columns, self.floats))

    def _runs(self, batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """The micro-batch in lists that are large, but bounded."""
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            if self.done:
                continue
            more = list(zip(*(batch[c].tolist() for c in (self.position_name, *self.columns))))
            rows += more
            chars += _chars(more)
            if len(rows) >= RUN_ROWS or chars >= RUN_CHARS:
                yield rows
                rows, chars = [], 0
        if rows and not self.done:
            yield rows

    def _load(self, here: dict[int, tuple[int, tuple]], upto: int) -> None:
        """Brings in the next block. Of two rows of a position, the later one is kept."""
        _, number = heappop(self.blocks)
        rows = zip(*self.early.getValue((number,)))
        self.early.removeKey((number,))
        for row in rows:
            # Rows that were passed over are never due, but still known.
            if row[0] >= upto:
                self.waiting -= 1
                if row[0] not in here or here[row[0]][0] < number:
                    here[row[0]] = (number, row)

    def _store(self, here: dict[int, tuple[int, tuple]]) -> None:
        """Puts the rows away, in order and in blocks."""
        rows: list[tuple] = []
        chars = 0
        for position in sorted(here):
            row = here[position][1]
            size = _chars([row])
            if rows and (len(rows) >= BLOCK_ROWS or chars + size > BLOCK_CHARS):
                self._store_block(rows)
                rows, chars = [], 0
            rows.append(row)
            chars += size
        if rows:
            self._store_block(rows)
        here.clear()

    def _store_block(self, rows: list[tuple]) -> None:
        self.early.updateValue((self.made,), self._columns(rows))
        heappush(self.blocks, (rows[0][0], self.made))
        self.made += 1
        self.waiting += len(rows)

    def _due(self, here: dict[int, tuple[int, tuple]], upto: int) -> tuple[list[tuple], int]:
        ready = []
        while len(ready) < TAKEN:
            while self.blocks and self.blocks[0][0] <= upto:
                self._load(here, upto)
            if upto not in here:
                break
            row = here.pop(upto)[1]
            ready.append(row)
            after = self.following(row)
            if after <= upto:
                break
            upto = after
        return ready, upto

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self.done = self.ended.exists()
        if self.done:
            for _ in rows:
                pass
            return
        upto, self.waiting, self.made, firsts, numbers, *held = self.place.get() or (0, 0, 0, [], [])
        self.blocks = sorted(zip(firsts, numbers))
        # Rows at hand by position, each with the number of the block that it came in; those of no block are the latest.
        here = {row[0]: (self.made, row) for row in zip(*held)}
        self.waiting -= len(here)
        for run in self._runs(rows):
            here.update((r[0], (self.made, r)) for r in run if r[0] >= upto)
            while not self.done:
                ready, upto = self._due(here, upto)
                if not ready:
                    break
                out = []
                for row in self.take(ready):
                    out.append(row)
                    if len(out) >= TAKEN:
                        yield self._frame(key, out)
                        out = []
                if out:
                    yield self._frame(key, out)
            passed = [position for position in here if position < upto]
            for position in passed:
                del here[position]
            self.waiting += len(passed)
            if not self.done and (len(here) > BLOCK_ROWS or _chars(row for _, row in here.values()) > BLOCK_CHARS):
                self._store(here)
        if self.done:
            self._end()
        else:
            firsts, numbers = ([block[i] for block in self.blocks] for i in range(2))
            self.place.update((upto, self.waiting + len(here), self.made, firsts, numbers, *self._columns([row for _, row in here.values()])))
            if self.idle_ms is not None:
                self._clear_timers()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _end(self) -> None:
        if self.idle_ms is not None:
            self._clear_timers()
        self.place.clear()
        if self.made:
            self.early.clear()
        self.forget()
        self.ended.update((True,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            _, waiting, self.made, *_ = self.place.get() or (0, 0, 0)
            out = list(self.finish(waiting))
            self._end()
            if out:
                yield self._frame(key, out)

    def close(self) -> None:
        pass


def ordered_stream(
    rows: DataFrame, processor: type[Ordered], key: str, position: str, *args: Any, idle_ms: int | None = None, remember_ms: int = REMEMBER_MS
) -> DataFrame:
    """The stream's rows through one processor per key; output rows begin with the key. State is kept by RocksDB."""
    fields = [position, *processor.columns]
    schema = StructType([rows.schema[name] for name in fields])
    made = processor(key, position, schema, idle_ms, remember_ms, *args)
    ship_package(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = rows.schema[key].dataType.simpleString()
    grouped = rows.select(key, *fields).groupBy(key)
    return grouped.transformWithStateInPandas(made, f"{key} {kind}, {processor.output}", "append", "ProcessingTime")


class Detection(Ordered):
    output = "start_sample bigint, end_sample bigint, error string"
    columns = ("end_sample", "dbfs", "is_last")

    def __init__(self, key: str, position: str, row_schema: Any, idle_ms: int | None, remember_ms: int, options: DetectorOptions):
        super().__init__(key, position, row_schema, idle_ms, remember_ms)
        self.options = options

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState(
            "scan",
            "floor double, above_run bigint, below_run bigint, onset bigint, speech array<bigint>, starts array<bigint>, "
            "levels array<double>, held array<bigint>, upto bigint",
        )

    def forget(self) -> None:
        self.scan.clear()

    def following(self, row: tuple) -> int:
        return row[1]

    def _loaded(self) -> tuple[FrameScan, Merger]:
        state = self.scan.get()
        if state is None:
            return FrameScan(self.options), Merger(self.options)
        *scan, held, upto = state
        scan = [list(x) if i >= 4 and x is not None else x for i, x in enumerate(scan)]
        found = FrameScan(self.options, scan)
        found.end = upto
        return found, Merger(self.options, list(held) if held is not None else None)

    def _ended(self, scan: FrameScan, merger: Merger) -> Iterator[tuple]:
        for _, _, start, end, kind in scan.pieces:
            merger.add(start, end, kind)
        if merger.failed:
            return iter([(None, None, "a maximum-length split produced an empty interval")])
        merger.flush()
        return ((*found, None) for found in merger.done)

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        if any(row[1] <= row[0] for row in rows):
            self.done = True
            return iter([(None, None, "a frame does not end behind its start")])
        scan, merger = self._loaded()
        scan.feed([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        if rows[-1][3]:
            self.done = True
            scan.finish()
            return self._ended(scan, merger)
        for _, _, start, end, kind in scan.pieces:
            merger.add(start, end, kind)
        if merger.failed:
            self.done = True
            return iter([(None, None, "a maximum-length split produced an empty interval")])
        floor, above, below, onset, speech, starts, levels = scan.state()
        whole = lambda values: None if values is None else [int(v) for v in values]
        state = (float(floor), above, below, int(onset), whole(speech), whole(starts), [float(v) for v in levels], whole(merger.previous), int(scan.end))
        self.scan.update(state)
        return ((*found, None) for found in merger.done)

    def finish(self, waiting: int) -> Iterator[tuple]:
        if waiting:
            return iter([(None, None, "frames are missing")])
        scan, merger = self._loaded()
        scan.finish()
        return self._ended(scan, merger)


def stream_detect(frames: DataFrame, options: DetectorOptions | None = None, idle_ms: int | None = None, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """Speech intervals from a stream of frames ``file_id, start_sample, end_sample, dbfs, is_last``.

    The frame marked ``is_last`` ends the recording and closes open speech; so does ``idle_ms`` without a frame, where
    given. An interval is emitted once nothing can merge into it any more, so the result is that of the batch detector.
    A recording that fails, has a frame that does not go forward, or is ended while frames before others are missing, ends with
    a row that has the ``error`` and no interval; what was emitted before stays, and other recordings go on. Rows of a
    recording that ended are dropped for ``remember_ms``; after that nothing of it is left in the state.
    """
    return ordered_stream(frames, Detection, "file_id", "start_sample", options or DetectorOptions(), idle_ms=idle_ms, remember_ms=remember_ms)


class Accumulation(Ordered):
    """The text lies in the state part by part, and an emission is compared with as many parts as it has itself:
    every comparison is exact, and no more of a transcript is in memory than the longer of a part and an emission."""

    output = "part_no bigint, text string"
    columns = ("text", "is_last")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part_no bigint", "text string")
        # Characters so far, and those behind the last full part.
        self.end = handle.getValueState("end", "length bigint, tail string")

    def forget(self) -> None:
        self.parts.clear()
        self.end.clear()

    def _begins(self, text: str, length: int, tail: str) -> bool:
        """Whether the transcript, ``length`` long, and the text are equal as far as both go."""
        upto = min(len(text), length)
        for at in range(0, upto, PART_CHARS):
            part = tail if at + PART_CHARS > length else self._part(at // PART_CHARS)
            if text[at : min(at + PART_CHARS, upto)] != part[: upto - at]:
                return False
        return True

    def _part(self, number: int) -> str:
        return self.parts.getValue((number,))[0]

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        length, tail = self.end.get() or (0, "")
        for _, text, last in rows:
            if text and text.strip():
                known = self._begins(text, length, tail)
                more = (text[length:] if len(text) > length else "") if known else text
                length += len(more)
                tail += more
                full = length // PART_CHARS - (length - len(tail)) // PART_CHARS
                first = (length - len(tail)) // PART_CHARS
                for k in range(full):
                    self.parts.updateValue((first + k,), (tail[k * PART_CHARS : (k + 1) * PART_CHARS],))
                tail = tail[full * PART_CHARS :]
            if last:
                self.done = True
                yield from self._all(length, tail)
                return
        self.end.update((length, tail))

    def _all(self, length: int, tail: str) -> Iterator[tuple]:
        full = length // PART_CHARS
        for number in range(full):
            yield (number, self._part(number))
        if tail or not full:
            yield (full, tail)

    def finish(self, waiting: int) -> Iterator[tuple]:
        return self._all(*(self.end.get() or (0, "")))


def stream_transcripts(responses: DataFrame, idle_ms: int | None = None, remember_ms: int = REMEMBER_MS) -> DataFrame:
    """Transcripts from a stream of emissions ``session_id, seq, text, is_last``, each once its session ends, in parts:
    ``session_id, part_no, text``. Without text there is one empty part. A session also ends after ``idle_ms`` without an emission,
    where given, with the text that had come in order."""
    return ordered_stream(responses, Accumulation, "session_id", "seq", idle_ms=idle_ms, remember_ms=remember_ms)


class Throttle(Ordered):
    output = "seq bigint"
    columns = ("seq", "at_us", "forced")

    def __init__(self, key: str, position: str, row_schema: Any, idle_ms: int | None, remember_ms: int, interval_ms: int):
        super().__init__(key, position, row_schema, idle_ms, remember_ms)
        self.interval = interval_ms * 1_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.published = handle.getValueState("published", "at_us bigint")

    def forget(self) -> None:
        self.published.clear()

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        last = (self.published.get() or (None,))[0]
        for _, seq, at, forced in rows:
            if forced or last is None or at - last >= self.interval:
                last = at
                yield (seq,)
        if last is not None:
            self.published.update((last,))


def stream_throttle(events: DataFrame, interval_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Published events of a stream ``batch_id, position, seq, at_us, forced`` with dense positions per batch."""
    return ordered_stream(events, Throttle, "batch_id", "position", interval_ms, idle_ms=idle_ms)


class Transitions(Ordered):
    output = "seq bigint, state string, verdict string"
    columns = ("seq", "state")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "rank int")

    def forget(self) -> None:
        self.reached.clear()

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        rank = {PENDING: 0, TRANSCRIBING: 1, **dict.fromkeys(TERMINAL, 2)}
        reached = (self.reached.get() or (-1,))[0]
        for _, seq, name in rows:
            at = rank.get(name)
            if at is None:
                verdict = "unknown state"
            elif reached == 2:
                verdict = "after terminal"
            else:
                verdict = "backwards" if at < reached else "ok"
                reached = max(reached, at)
            yield (seq, name, verdict)
        self.reached.update((reached,))


def stream_transitions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Every event of a stream ``job_id, position, seq, state`` with a verdict: ``ok`` or why it is not allowed."""
    return ordered_stream(events, Transitions, "job_id", "position", idle_ms=idle_ms)


class StageReports(Ordered):
    output = "seq bigint, stage string"
    columns = ("seq", "stage", "forced")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", "stage string")

    def forget(self) -> None:
        self.stage.clear()

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        stage = (self.stage.get() or (None,))[0]
        for _, seq, name, forced in rows:
            if forced:
                stage = name
            elif name == stage:
                yield (seq, name)
        if stage is not None:
            self.stage.update((stage,))


def stream_stage_reports(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Progress reports of the stage in force from a stream ``job_id, position, seq, stage, forced``.

    Lateness here is a matter of stages, not of time: a forced row changes the stage, and a report of any other stage
    comes too late and is dropped.
    """
    return ordered_stream(events, StageReports, "job_id", "position", idle_ms=idle_ms)
