"""Streams against their batch forms: rows far out of order, keys that end, are ended by the clock, and are forgotten."""

import time

import pytest
from pyspark.sql import functions as F

from voxtide.operators.transcripts import fold_text
from voxtide.options import DetectorOptions, SegmenterOptions
from voxtide.streaming import runs, stateful

FRAMES = "file_id long, start_sample long, end_sample long, dbfs double, is_last boolean"
OPTIONS = DetectorOptions(
    frame_samples=10, segmenter=SegmenterOptions(onset_frames=1, silence_frames=1, pre_roll=0, post_roll=0, min_speech=1, merge_gap=0, max_segment=100, split_search=10)
)


class Feed:
    """A stream of files that a test adds one by one, run a trigger at a time."""

    def __init__(self, spark, schema, make):
        self.spark, self.schema = spark, schema
        self.folder, self.out = runs.new_folder(spark, "feed"), runs.new_folder(spark, "out")
        spark.createDataFrame([], schema).write.parquet(self.folder)
        self.stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder))

    def add(self, rows):
        """One more micro-batch; what it put out."""
        before = self._found()
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        setting = "spark.sql.streaming.noDataMicroBatches.enabled"
        self.spark.conf.set(setting, "false")
        writer = self.stream.writeStream.format("parquet").option("checkpointLocation", self.out + "-state").option("path", self.out)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        self.spark.conf.unset(setting)
        after = self._found()
        for row in before:
            after.remove(row)
        return sorted(after, key=str)

    def _found(self):
        try:
            return [tuple(r) for r in self.spark.read.schema(self.stream.schema).parquet(self.out).collect()]
        except Exception:
            return []


def frame(file_id, k, loud, last=False):
    return (file_id, 10 * k, 10 * k + 10, -10.0 if loud else -90.0, last)


def test_early_frames_wait_and_ended_recordings_are_known(spark):
    feed = Feed(spark, FRAMES, lambda s: stateful.stream_detect(s, OPTIONS))
    # The end first, then the beginning, then what lies between.
    assert feed.add([frame(1, 4, False, True), frame(1, 3, True), frame(2, 0, True), (3, 0, 0, -10.0, False)]) == [(3, None, None, "a frame does not end behind its start")]
    assert feed.add([frame(1, 0, False), frame(2, 1, False, True), (3, 0, 10, -10.0, True)]) == [(2, 0, 10, None)]
    assert feed.add([frame(1, 2, False), frame(1, 1, True), frame(1, 1, True)]) == [(1, 10, 20, None), (1, 30, 40, None)]
    # Late repeats of recordings that ended.
    assert feed.add([frame(1, 0, True), frame(1, 1, False, True), frame(2, 0, True, True)]) == []


def test_the_clock_ends_and_forgets_recordings(spark):
    feed = Feed(spark, FRAMES, lambda s: stateful.stream_detect(s, OPTIONS, idle_ms=1_000, remember_ms=1_000))
    assert feed.add([frame(1, 0, True), frame(1, 1, True), frame(2, 0, True), frame(2, 2, True), frame(3, 0, True, True)]) == [(3, 0, 10, None)]
    time.sleep(1.5)
    # The next batch finds the timers of 1 and 2 due, and has forgotten that 3 ended.
    assert feed.add([frame(3, 0, False), frame(3, 1, True, True)]) == [(1, 0, 20, None), (2, None, None, "frames are missing"), (3, 10, 20, None)]


@pytest.mark.parametrize("size", [7, 4_096])
def test_transcripts_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(stateful, "PART_CHARS", size)
    emissions = ["it was", " a long", "it was a long day", "it was a", "it was a long day and", "it is", "", " ", None, "it was a long day andit is over", "x" * 20, "it was a long day andit is over"]
    rows = [(k, n, text, n == len(emissions) - 1) for k in (1, 2) for n, text in enumerate(emissions)]
    rows += [(3, 0, None, True)]
    df = spark.createDataFrame(rows, "session_id long, seq long, text string, is_last boolean")
    parts = runs.drain(stateful.stream_transcripts(runs.land(df, "said", ["session_id", "seq"])), "parts").collect()
    want = ""
    for text in emissions:
        if text and text.strip():
            want = fold_text(want, text)
    for k in (1, 2):
        mine = sorted((r.part_no, r.text) for r in parts if r.session_id == k)
        # Each worker has its own copy of the module, whose size of a part is the usual one.
        assert "".join(t for _, t in mine) == want and [n for n, _ in mine] == list(range(len(mine)))
    assert [(r.part_no, r.text) for r in parts if r.session_id == 3] == [(0, "")]


def test_parts_of_any_size_compare_exactly(monkeypatch):
    """The processor alone, over a dictionary for its state."""

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        def getValue(self, key):
            return self[key]

        def updateValue(self, key, value):
            self[key] = value

    for size in (1, 2, 3, 5, 64):
        monkeypatch.setattr(stateful, "PART_CHARS", size)
        for texts in (["ab", "abab", "ab", "abababx", "b", "abababxbq", "abababxb"], ["a", "a", "aa", "aaa", "b", "aaabb"], ["abcdefgh", "abcdefghij", "abcdefghXX"]):
            made = stateful.Accumulation("k", "seq", None, None, 0)
            made.parts, made.end = Map(), Value()
            want = ""
            for n, text in enumerate(texts):
                want = fold_text(want, text)
                out = list(made.take([(n, text, n == len(texts) - 1)]))
            assert "".join(t for _, t in out) == want and all(len(t) == size for _, t in out[:-1])


def test_land_deals_rows_out_of_order(spark):
    df = spark.range(300).select((F.col("id") % 5).alias("k"), F.col("id").alias("position"))
    stream = runs.land(df, "dealt", ["k", "position"])
    assert stream.isStreaming and runs.drain(stream, "same").count() == 300


def test_waiting_rows_are_kept_in_blocks(monkeypatch):
    """The processor alone: a key that comes backwards asks the state for blocks and not for rows."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    class Handle:
        def getValueState(self, *args, **kwargs):
            return Value()

        def getMapState(self, *args):
            return Map()

    schema = StructType([StructField(n, LongType()) for n in ("position", "seq", "at_us", "forced")])
    made = stateful.Throttle("k", "position", schema, None, 0, 1)
    made.init(Handle())
    rows = [(n, n, n * 400, n % 11 == 0) for n in range(20_000)]
    want, last = [], None
    for _, seq, at, forced in rows:
        if forced or last is None or at - last >= 1_000:
            want.append(seq)
            last = at
    found = []
    # Positions that leave the remainders 2, 1 and 0, so that all but the last third wait; the second third has a repeat.
    for rest in (2, 1, 0):
        batch = pd.DataFrame([r for r in rows[::-1] if r[0] % 3 == rest] + ([rows[2]] if rest == 1 else []), columns=["position", "seq", "at_us", "forced"])
        for out in made.handleInputRows((1,), iter([batch[:4_000], batch[4_000:]]), None):
            found += out["seq"].tolist()
    assert found == want and not made.early and made.place.get()[:2] == (20_000, 0)
    assert made.early.calls < 200
