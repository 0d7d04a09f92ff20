"""The per-recording frame scan that both the batch and the streaming detector run inside tasks.

It is the one rule that windows cannot express: with an adaptive noise floor each frame's thresholds depend on how all
earlier frames were judged, and an over-long stretch is cut at places that depend on earlier cuts. Its state is a few
numbers plus the frames of one split-search window.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from voxtide.options import DetectorOptions

FORCED, NATURAL, TAIL = "forced", "natural", "tail"


class FrameScan:
    """Feeds frames in order and collects pieces ``(island, k, start, end, kind)``.

    ``island`` is the first sample of the stretch, ``k`` counts its pieces. ``forced`` pieces end at a cut, ``tail``
    is what remains after the last cut, ``natural`` pieces were never cut.
    """

    def __init__(self, options: DetectorOptions, state: Any = None) -> None:
        self.options = options
        if state is None:
            state = [options.initial_floor, 0, 0, 0, None, [], []]
        self.floor, self.above_run, self.below_run, self.onset, self.speech, self.starts, self.levels = state
        self.fresh = 0
        self.end = 0
        self.pieces: list[tuple] = []

    def state(self) -> list:
        """What the next frames need, as JSON-ready values."""
        keep: slice = slice(0, 0)
        if self.starts and (self.speech is not None or self.above_run):
            oldest = self.starts[-1] - self.options.segmenter.split_search
            keep = slice(max(self.fresh, int(np.searchsorted(self.starts, oldest))), None)
        return [
            self.floor,
            self.above_run,
            self.below_run,
            self.onset if self.above_run else 0,
            self.speech,
            self.starts[keep],
            self.levels[keep],
        ]

    def feed(self, starts: list, ends: list, levels: list, above: list | None = None, below: list | None = None) -> None:
        opts, seg = self.options, self.options.segmenter
        given = above is not None
        offset = len(self.starts)
        self.starts = self.starts + starts
        self.levels = self.levels + levels
        for i, (start, end, level) in enumerate(zip(starts, ends, levels)):
            if given:
                loud, quiet = above[i], below[i]
            else:
                loud = level >= max(opts.min_on, self.floor + opts.on_margin)
                quiet = level < max(opts.min_off, self.floor + opts.off_margin)
            self.above_run = self.above_run + 1 if loud else 0
            self.below_run = self.below_run + 1 if quiet else 0
            if self.speech is None:
                if self.above_run == 0:
                    self.fresh = offset + i + 1
                elif self.above_run == 1:
                    self.fresh, self.onset = offset + i, start
                if self.above_run >= seg.onset_frames:
                    # island, pieces so far, core start, output start, end of the last frame that was not quiet
                    self.speech = [self.onset, 0, self.onset, max(0, self.onset - seg.pre_roll), end]
            elif not quiet:
                self.speech[4] = end
            if self.speech is not None:
                self._cut(end, offset + i)
                if self.below_run >= seg.silence_frames:
                    self._close(end)
                    self.fresh = offset + i + 1
            if not given and self.speech is None and quiet:
                seen = opts.min_floor if level == float("-inf") else level
                moved = self.floor + opts.adaptation * (seen - self.floor)
                self.floor = min(max(moved, opts.min_floor), opts.max_floor)
            self.end = end

    def finish(self) -> None:
        """Closes what is open at the end of the recording."""
        if self.speech is not None:
            self._cut(self.end, len(self.starts) - 1)
            self._close(self.end)

    def _emit(self, start: int, end: int, kind: str) -> None:
        self.pieces.append((self.speech[0], self.speech[1], start, end, kind))
        self.speech[1] += 1

    def _cut(self, available: int, at: int) -> None:
        seg = self.options.segmenter
        while min(available, self.speech[4] + seg.post_roll) > self.speech[3] + seg.max_segment:
            begin = self.speech[3]
            limit = begin + seg.max_segment
            lowest = max(begin + 1, limit - seg.split_search, self.starts[at] - seg.split_search)
            window = np.array(self.starts[self.fresh : at + 1], dtype=np.int64)
            usable = np.flatnonzero((window >= lowest) & (window <= limit))
            cut = limit
            if usable.size:
                level = np.array(self.levels[self.fresh : at + 1])[usable]
                quietest = usable[level == level.min()]
                cut = int(window[quietest[-1]])
            self._emit(begin, cut, FORCED)
            self.speech[2] = self.speech[3] = max(begin, cut - seg.split_overlap)
            self.fresh = at + 1

    def _close(self, available: int) -> None:
        seg = self.options.segmenter
        _, cuts, core, begin, voiced = self.speech
        end = min(available, voiced + seg.post_roll, begin + seg.max_segment)
        if end > begin and (cuts or voiced - core >= seg.min_speech):
            self._emit(begin, end, TAIL if cuts else NATURAL)
        self.speech = None


class Merger:
    """Joins near natural pieces up to the maximum length; other pieces only give way to what came before."""

    def __init__(self, options: DetectorOptions, previous: list | None = None) -> None:
        self.seg = options.segmenter
        self.previous = previous
        self.done: list[tuple[int, int]] = []
        self.failed = False

    def add(self, start: int, end: int, kind: str) -> None:
        if self.previous is not None:
            before, upto = self.previous
            if kind == NATURAL and start <= upto + self.seg.merge_gap:
                if max(upto, end) - before <= self.seg.max_segment:
                    self.previous[1] = max(upto, end)
                    return
            start = max(start, upto)
            if end <= start:
                self.failed = self.failed or kind == FORCED
                return
            self.flush()
        self.previous = [start, end]

    def flush(self) -> None:
        if self.previous is not None:
            self.done.append(tuple(self.previous))
            self.previous = None
