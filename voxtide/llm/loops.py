"""Recogniser loops: stretches of a transcript in which the same words come again and again."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from voxtide.llm.batches import by_bytes
from voxtide.llm.word_bpe import CHUNK

# Residues whose differences are all residues modulo COVER: any two positions reach sampled ones by one same step.
COVER, RESIDUES = 13, (0, 1, 3, 9)
# Text bytes whose transcripts are searched together, and grid points looked at at once.
BATCH_BYTES, GRID_POINTS = 2 << 20, 1 << 20

RUN = StructType([StructField(name, LongType(), False) for name in ("start", "length", "period")])


def _steps() -> np.ndarray:
    """For each two residues, the least step after which both are sampled."""
    sampled = set(RESIDUES)
    return np.array(
        [[min(d for d in range(COVER) if {(a + d) % COVER, (b + d) % COVER} <= sampled) for b in range(COVER)] for a in range(COVER)]
    )


class Extensions:
    """How many words are equal from two positions of a sequence on.

    Only suffixes at sampled positions are sorted: by their first ``COVER`` words, then by doubling that length, which
    stays among samples of one residue. A query compares words up to the next pair of samples; from there the answer
    is the least common prefix between the two in sorted order, read from a sparse table of minima. The sequence's
    last value must occur nowhere else.
    """

    def __init__(self, values: np.ndarray):
        size = len(values)
        self.values = np.concatenate([values, np.full(COVER, -1, dtype=values.dtype)])
        self.step_of = _steps()
        self.slot = np.full(COVER, -1, dtype=np.int64)
        self.slot[list(RESIDUES)] = np.arange(len(RESIDUES))
        at = (np.arange(0, size, COVER)[:, None] + np.array(RESIDUES)).ravel()
        at = at[at < size]
        levels = [self._first_ranks(at)]
        ahead = len(RESIDUES)
        while levels[-1].max(initial=-1) + 1 < len(at):
            ranks = levels[-1]
            after = np.zeros(len(at), dtype=np.int64)
            after[:-ahead] = ranks[ahead:] + 1
            levels.append(np.unique(ranks * (len(at) + 1) + after, return_inverse=True)[1])
            ahead *= 2
        self.rank = levels[-1]
        self.minima = [self._common_prefixes(at, np.argsort(self.rank), levels[:-1])]
        width = 1
        while 2 * width <= len(self.minima[0]):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _first_ranks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first ``COVER`` words, several of which are packed into one number."""
        bits = max(1, int(self.values.max(initial=0) + 1).bit_length())
        together = max(1, 62 // bits)
        keys = []
        for first in range(0, COVER, together):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(first, min(first + together, COVER)):
                key = key << bits | (self.values[np.minimum(at + k, len(self.values) - 1)] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), dtype=bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks = np.empty(len(at), dtype=np.int64)
        ranks[order] = np.cumsum(new)
        return ranks

    def _common_prefixes(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Equal words between neighbours in sorted order: the longest equal stretches first, then word by word."""
        a, b = order[:-1].copy(), order[1:].copy()
        words = np.zeros(len(a), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[level][a] == levels[level][b])
            words[same] += COVER << level
            a[same] += len(RESIDUES) << level
            b[same] += len(RESIDUES) << level
        return words + self._compared(at[a], at[b], np.full(len(a), COVER))

    def _compared(self, a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Equal words from each two positions on, at most ``upto``."""
        words = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        for k in range(int(upto.max(initial=0))):
            live = live[(k < upto[live]) & (self.values[a[live] + k] == self.values[b[live] + k])]
            words[live] += 1
            if not len(live):
                break
        return words

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on; no two positions of a pair may be the same."""
        step = self.step_of[a % COVER, b % COVER]
        words = self._compared(a, b, step)
        far = np.flatnonzero(words == step)
        p, q = a[far] + step[far], b[far] + step[far]
        ranks = [self.rank[x // COVER * len(RESIDUES) + self.slot[x % COVER]] for x in (p, q)]
        low, high = np.minimum(*ranks), np.maximum(*ranks)
        # Powers of two are exact in floating point.
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            table = self.minima[k]
            words[far[here]] += np.minimum(table[low[here]], table[high[here] - (1 << k)])
        return words


def _grid(begins: np.ndarray, sizes: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Owner, position and period of the grid: every multiple of twice a period in each sequence, for all periods
    that could be repeated often enough."""
    owner = np.repeat(np.arange(len(sizes)), sizes // repeats)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(sizes // repeats) - sizes // repeats, sizes // repeats) + 1
    points = -(-(sizes[owner] - period) // (2 * period))
    ends = np.cumsum(points)
    first = 0
    while first < len(owner):
        before = int(ends[first - 1]) if first else 0
        upto = max(first + 1, int(np.searchsorted(ends, before + GRID_POINTS, side="right")))
        count = points[first:upto]
        which = np.repeat(np.arange(first, upto), count)
        nth = np.arange(len(which)) - np.repeat(ends[first:upto] - count - before, count)
        q = period[which]
        yield owner[which], begins[owner[which]] + 2 * q * nth, q
        first = upto


def _joined(sequences: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences between values that occur once each, and where they begin."""
    parts = [np.array([top], dtype=np.int64)]
    for k, sequence in enumerate(sequences):
        parts += [sequence, np.array([top + k + 1], dtype=np.int64)]
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    return np.concatenate(parts), np.cumsum(sizes + 1) - sizes


def find_runs(sequences: list[np.ndarray], least: int, repeats: int) -> list[np.ndarray]:
    """Of each sequence of numbers from 0 on, its maximal stretches with smallest period ``q`` and at least
    ``max(least, repeats * q)`` long, as rows of start, length and period, in that order.

    ``repeats`` is 4 at least. Such a stretch holds a grid point that, with its next period, lies in it and has a
    whole period of it on either side, so points without that many equal words ahead are passed over, and sequences
    without any other point need no sorting.
    """
    if repeats < 4:
        raise ValueError("runs of four periods at least")
    found = [np.empty((0, 3), dtype=np.int64) for _ in sequences]
    top = max((int(s.max(initial=-1)) for s in sequences), default=-1) + 1
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)

    def hits(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        padded = np.concatenate([values, np.full(COVER, -1)])
        for owner, at, period in _grid(begins, lengths, repeats):
            for k in range(COVER):
                on = (padded[at + k] == padded[at + period + k]) | (k > period)
                owner, at, period = owner[on], at[on], period[on]
            yield owner, at, period

    values, begins = _joined(sequences, top)
    chosen = sorted({int(i) for owner, _, _ in hits(values, begins, sizes) for i in np.unique(owner)})
    if not chosen:
        return found
    values, begins = _joined([sequences[i] for i in chosen], top)
    ahead, behind, last = Extensions(values), Extensions(values[::-1].copy()), len(values) - 1
    runs = np.empty((0, 4), dtype=np.int64)
    for owner, at, period in hits(values, begins, sizes[chosen]):
        right = ahead.of(at, at + period)
        left = behind.of(last - at + 1, last - at - period + 1)
        length = left + right + period
        long = length >= np.maximum(least, repeats * period)
        here = np.stack([owner, at - left - begins[owner], length, period], axis=1)[long]
        # A stretch found with several periods has the least of them.
        runs = np.unique(np.concatenate([runs, here]), axis=0)
        runs = runs[np.concatenate([[True], (runs[1:, :3] != runs[:-1, :3]).any(axis=1)])] if len(runs) else runs
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    edges = np.searchsorted(runs[:, 0], np.arange(len(chosen) + 1))
    for k, i in enumerate(chosen):
        found[i] = runs[edges[k] : edges[k + 1], 1:]
    return found


def _numbered(texts: list[list[str]]) -> list[np.ndarray]:
    """Words as numbers, equal ones alike in all texts."""
    numbers: dict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]


def _collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those that a run repeats."""
    if not len(runs):
        return " ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return " ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def find_loops(transcripts: DataFrame, least_words: int = 6, least_repeats: int = 4) -> DataFrame:
    """All columns of the transcripts, and where the words of ``text`` repeat themselves, as a recogniser that is
    stuck makes them do.

    ``runs`` (array of ``start, length, period``, in words from 0, by start, then period) holds every stretch of
    consecutive words with smallest period ``period`` that no neighbouring word extends and that has at least
    ``max(least_words, least_repeats * period)`` words; ``least_repeats`` is 4 at least. ``strongest`` is the run with
    the greatest length for its period, compared exactly (ties: least start, then period), null without runs.
    ``collapsed`` is the text with each run cut to its first period: a word goes if any run contains it behind that
    run's first period; what stays is joined by single blanks. Words are cut at ASCII white space and compared as
    they stand.

    Null texts count as empty: no runs, an empty ``collapsed``. Columns named like the three new ones are replaced,
    others pass through. Repeated rows are searched one by one; an empty table gives no rows. Time and memory grow
    with a text's length times its logarithm, however repetitive it is, and a text is searched whole.
    """
    rows = transcripts.drop("runs", "strongest", "collapsed")
    names = rows.columns
    at = names.index("text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at, BATCH_BYTES):
            words = [CHUNK.findall(text or "") for text in batch.column(at).to_pylist()]
            runs = find_runs(_numbered(words), least_words, least_repeats)
            offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            every = np.concatenate(runs).astype(np.int64)
            fields = [pa.array(np.ascontiguousarray(every[:, k])) for k in range(3)]
            struct = pa.StructArray.from_arrays(fields, fields=[pa.field(n, pa.int64(), nullable=False) for n in RUN.names])
            listed = pa.ListArray.from_arrays(pa.array(offsets), struct)
            collapsed = pa.array(list(map(_collapsed, words, runs)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed, collapsed], [*names, "runs", "collapsed"])

    added = [StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())]
    searched = rows.mapInArrow(search, StructType([*rows.schema.fields, *added]))
    none = F.lit(None).cast(RUN)
    better = lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
    ).otherwise(best)
    return searched.withColumn("strongest", F.aggregate("runs", none, better))
