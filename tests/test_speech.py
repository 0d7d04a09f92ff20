"""Detection against literal cases and a frame-by-frame model."""

import random

import pytest

from voxtide.operators.speech import NO_CAP, detect_speech, latch, numbered
from voxtide.options import DetectorOptions, SegmenterOptions

CASES = [
    ((2, 2, 5, 5, 1, 0, 100, 10), "BAAMBB", None, [(5, 45)]),
    ((1, 1, 0, 0, 11, 0, 100, 10), "AB", None, []),
    ((1, 2, 0, 5, 1, 0, 100, 10), "AA", None, [(0, 20)]),
    ((1, 1, 0, 0, 1, 10, 100, 10), "ABAB", None, [(0, 30)]),
    ((1, 10, 0, 0, 1, 0, 30, 20), "AAAA", [-10, -20, -80, -15], [(0, 20), (20, 40)]),
    ((1, 1, 10, 20, 1, 0, 30, 10), "BAAB", [-90, -10, -10, -90], [(0, 30), (30, 40)]),
]


def seg(t):
    onset, silence, pre, post, speech, gap, longest, search = t
    return SegmenterOptions(onset, silence, pre, post, speech, gap, longest, search)


def frames_df(spark, files, size=10):
    rows = []
    for f, (marks, levels) in enumerate(files):
        levels = levels or [-30.0] * len(marks)
        rows += [
            (f, i, i * size, (i + 1) * size, float(levels[i]), m == "A", m == "B") for i, m in enumerate(marks)
        ]
    return spark.createDataFrame(
        rows, "file_id bigint, frame_idx bigint, start_sample bigint, end_sample bigint, dbfs double, above boolean, below boolean"
    )


def collect(df, n):
    out = [[] for _ in range(n)]
    for r in df.collect():
        out[r.file_id].append((r.start_sample, r.end_sample))
    return [sorted(x) for x in out]


def model(marks, levels, o, size=10, adaptive=None):
    """Plain step-by-step reading of the rules, kept apart from the library's own scan."""
    out, on, above_run, below_run, cand, floor = [], False, 0, 0, [], adaptive.initial_floor if adaptive else 0
    start = begin = voiced = core = 0
    follows = False

    def put(a, b, kind):
        if out:
            s, e = out[-1]
            if kind == "n" and a <= e + o.merge_gap and max(b, e) - s <= o.max_segment:
                out[-1] = (s, max(b, e))
                return
            a = max(a, e)
        if b > a:
            out.append((a, b))
        elif kind == "f":
            raise ValueError

    def cut(avail):
        nonlocal begin, core, follows, cand
        while min(avail, voiced + o.post_roll) > begin + o.max_segment:
            limit = begin + o.max_segment
            ok = [(lv, -s) for s, lv in cand if begin < s <= limit and s >= max(0, limit - o.split_search)]
            at = -min(ok)[1] if ok else limit
            put(begin, at, "f")
            core = begin = max(begin, at - o.split_overlap)
            follows, cand = True, []

    def close(avail):
        nonlocal on
        end = min(avail, voiced + o.post_roll, begin + o.max_segment)
        if end > begin and (follows or voiced - core >= o.min_speech):
            put(begin, end, "t" if follows else "n")
        on = False

    for i, m in enumerate(marks):
        s, e, lv = i * size, (i + 1) * size, levels[i]
        if adaptive:
            a = lv >= max(adaptive.min_on, floor + adaptive.on_margin)
            b = lv < max(adaptive.min_off, floor + adaptive.off_margin)
        else:
            a, b = m == "A", m == "B"
        if not on:
            if not a:
                above_run, cand = 0, []
            else:
                if above_run == 0:
                    start, cand = s, []
                above_run += 1
                cand = [c for c in cand + [(s, lv)] if c[0] >= s - o.split_search]
                if above_run >= o.onset_frames:
                    on, core, begin, voiced = True, start, max(0, start - o.pre_roll), e
                    below_run, follows, above_run = 0, False, 0
                    cut(e)
        else:
            cand = [c for c in cand + [(s, lv)] if c[0] >= s - o.split_search]
            if b:
                below_run += 1
            else:
                below_run, voiced = 0, e
            cut(e)
            if below_run >= o.silence_frames:
                close(e)
                cand = []
        if adaptive and not on and b:
            seen = adaptive.min_floor if lv == float("-inf") else lv
            floor = min(max(floor + adaptive.adaptation * (seen - floor), adaptive.min_floor), adaptive.max_floor)
    if on:
        total = len(marks) * size
        cut(total)
        close(total)
    return out


@pytest.mark.parametrize("timing, marks, levels, expected", CASES)
def test_literal_cases(spark, timing, marks, levels, expected):
    options = DetectorOptions(frame_samples=10, segmenter=seg(timing))
    df = frames_df(spark, [(marks, levels)])
    assert collect(detect_speech(df, options, adaptive=False, block_size=16), 1) == [expected]


def random_files(count, length, seed):
    rng = random.Random(seed)
    files = []
    for _ in range(count):
        marks, levels = "", []
        while len(marks) < length:
            m = rng.choice("AAABBM")
            n = rng.choice([1, 1, 2, 3, 5, 8])
            marks += m * n
            levels += [rng.choice([-5.0, -10.0, -20.0, -40.0, float("-inf")]) for _ in range(n)]
        files.append((marks, levels))
    return files


@pytest.mark.parametrize(
    "timing, block",
    [((2, 3, 10, 10, 20, 15, 120, 40), 16), ((1, 2, 0, 5, 1, 30, 70, 30), 8), ((3, 4, 15, 10, 30, 20, NO_CAP, 40), 16)],
)
def test_fixed_thresholds_match_the_model(spark, timing, block):
    files = random_files(40, 150, timing[0])
    options = DetectorOptions(frame_samples=10, segmenter=seg(timing))
    got = collect(detect_speech(frames_df(spark, files), options, adaptive=False, block_size=block), len(files))
    expected = []
    for marks, levels in files:
        try:
            expected.append(model(marks, levels, options.segmenter))
        except ValueError:
            expected.append([])
    assert got == expected


@pytest.mark.parametrize("block", [32, 1 << 18])
def test_adaptive_scan_matches_the_model_across_blocks(spark, block):
    rng = random.Random(5)
    files = []
    for _ in range(20):
        levels, level = [], -70.0
        for _ in range(300):
            level = level if rng.random() < 0.9 else rng.choice([-75.0, -62.0, -50.0, -30.0, -12.0, float("-inf")])
            levels.append(level + rng.random() if level > -100 else level)
        files.append(("M" * 300, levels))
    options = DetectorOptions(frame_samples=10, segmenter=SegmenterOptions(2, 3, 10, 10, 20, 15, 150, 40))
    df = frames_df(spark, files).drop("above", "below")
    got = collect(detect_speech(df, options, block_size=block), len(files))
    assert got == [model(m, lv, options.segmenter, adaptive=options) for m, lv in files]


def test_latch_state_and_numbering(spark):
    files = random_files(10, 100, 3)
    options = DetectorOptions(frame_samples=10, segmenter=seg((2, 3, 0, 0, 1, 0, NO_CAP, 10)))
    rows = latch(frames_df(spark, files), options, block_size=8).collect()
    got = {(r.file_id, r.frame_idx): r.in_speech for r in rows}
    for f, (marks, _) in enumerate(files):
        on, a, b = False, 0, 0
        for i, m in enumerate(marks):
            a = a + 1 if m == "A" else 0
            b = b + 1 if m == "B" else 0
            on = True if a >= 2 and not on else (False if b >= 3 and on else on)
            assert got[(f, i)] == on
    df = numbered(detect_speech(frames_df(spark, files), options, adaptive=False, block_size=8))
    for r in df.groupBy("file_id").agg({"idx": "max", "start_sample": "count"}).collect():
        assert r[1] == r[2] - 1
