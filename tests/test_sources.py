"""Files in, captions out."""

import hashlib
import io
import json
import os
import pickle
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from voxtide.operators.audit import output_evidence
from voxtide.operators.cues import document_errors, parse_documents
from voxtide.operators.frames import frame_blocks, frame_samples, score_pcm
from voxtide.operators.listing import plan_work
from voxtide.operators.quality import fixture_rules, ground_truth_rules, header_rules, text_rules
from voxtide.operators.synth import corpus
from voxtide.plans.evaluate import evaluate_documents
from voxtide.plans.queries import QUERIES
from voxtide.plans.transcribe import check_plan, transcribe
from voxtide.sources import files, keyed, manifest, ranges, sinks, wave


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def fmt(tag=1, channels=1, rate=16_000, bits=16, byte_rate=None, align=None):
    align = channels * bits // 8 if align is None else align
    return chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, rate * align if byte_rate is None else byte_rate, align, bits))


def riff(*chunks, kind=b"RIFF", form=b"WAVE", grow=0):
    body = form + b"".join(chunks)
    return kind + struct.pack("<I", len(body) + grow) + body


DATA = chunk(b"data", np.arange(6, dtype="<i2").tobytes())
WAVES = {
    "good": (riff(fmt(), chunk(b"junk", b"odd"), DATA), None),
    "data-first": (riff(DATA, fmt()), None),
    "rf64": (riff(fmt(), DATA, kind=b"RF64"), "RF64 is not supported"),
    "rifx": (riff(fmt(), DATA, kind=b"RIFX"), "not a RIFF file"),
    "form": (riff(fmt(), DATA, form=b"AVI "), "not a WAVE form"),
    "declared": (riff(fmt(), DATA, grow=10), "declared size exceeds the file"),
    "tag": (riff(fmt(tag=3), DATA), "not PCM"),
    "stereo": (riff(fmt(channels=2), DATA), "not 16 kHz mono 16-bit"),
    "rate": (riff(fmt(rate=8_000), DATA), "not 16 kHz mono 16-bit"),
    "byte-rate": (riff(fmt(byte_rate=5), DATA), "wrong byte rate"),
    "align": (riff(fmt(align=4), DATA), "wrong block alignment"),
    "no-fmt": (riff(DATA), "missing fmt chunk"),
    "no-data": (riff(fmt()), "missing data chunk"),
    "two-fmt": (riff(fmt(), fmt(), DATA), "duplicate fmt chunk"),
    "two-data": (riff(fmt(), DATA, DATA), "duplicate data chunk"),
    "unaligned": (riff(fmt(), chunk(b"data", b"abc")), "data is not aligned to samples"),
    "short": (b"RIFF", "file is too short"),
}


def test_wave_layouts(spark, tmp_path):
    for name, (content, _) in WAVES.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    scanned = wave.scan_wave(files.list_recordings(spark, str(tmp_path), "wav"))
    rows = {os.path.basename(r.path)[:-4]: r for r in scanned.collect()}
    assert {n: r.error for n, r in rows.items()} == {n: e for n, (_, e) in WAVES.items()}
    good = rows["good"]
    assert (good.sample_count, good.data_length) == (6, 12)
    assert WAVES["good"][0][good.data_offset :][:12] == np.arange(6, dtype="<i2").tobytes()
    hashes = {(r.pcm_sha, r.error) for r in wave.data_hashes(scanned).collect()}
    assert hashes == {(hashlib.sha256(np.arange(6, dtype="<i2").tobytes()).hexdigest().upper(), None)}
    assert wave.scan_wave(spark.createDataFrame([], "path string")).collect() == []
    gone = spark.createDataFrame([(str(tmp_path / "gone.wav"),), (None,)], "path string")
    assert [r.error for r in wave.scan_wave(gone).collect()] == ["the recording is missing"]


class Counted(io.BytesIO):
    """A file that counts what is read of it, and how far it was read."""

    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_layouts_come_from_a_few_bytes():
    silence = chunk(b"data", b"\0" * 3_000_000)
    for body in (riff(fmt(), silence), riff(silence, fmt()), riff(chunk(b"LIST", b"x" * 70_001), fmt(), silence)):
        file = Counted(body)
        found = ranges.read_layout(ranges.Recording(file))
        assert found[:4] == (16_000, 1, 16, 2) and found[5] == 3_000_000 and file.taken <= 12 + 3 * 8 + 16


class Sparse:
    """A file of over two gigabytes that is silence but for its header."""

    def __init__(self, head, size):
        self.head, self.length, self.at, self.taken = head, size, 0, 0

    def size(self):
        return self.length

    def seek(self, at, whence=0):
        self.at = at
        return at

    def read(self, n):
        got = self.head[self.at : self.at + n]
        got += b"\0" * (max(0, min(n, self.length - self.at)) - len(got))
        self.at += n
        self.taken += len(got)
        return got


def test_recordings_of_over_two_gigabytes_are_read_in_ranges():
    size = 3_000_000_000
    head = b"RIFF" + struct.pack("<I", size + 36) + b"WAVE" + fmt() + b"data" + struct.pack("<I", size)
    file = Sparse(head, size + 44)
    begin = 2_900_000_001
    blocks = list(wave.blocks_of(ranges.Recording(file), begin, begin + 2_000_000, 640))
    assert blocks[0][0] % 320 == 0 and 0 <= 44 + 2 * blocks[0][0] - begin < 640
    assert sum(len(pcm) for _, pcm in blocks) == file.taken - 12 - 2 * 8 - 16 <= 2_000_000 + 640


def test_ranges_cover_every_frame_once():
    pcm = np.arange(5_003, dtype="<i2").tobytes()
    body = riff(chunk(b"junk", b"odd"), fmt(), chunk(b"data", pcm))
    for split in (1, 50, 637, 640, 5_000, 1 << 20):
        parts = wave.plan_ranges([("a", len(body)), ("b", 0)], split)
        files_of = [p for part in parts for p in part.parts]
        assert [p for p in files_of if p[0] == "b"] == [("b", 0, 0, 0)]
        blocks = [b for _, _, begin, end in files_of[:-1] for b in wave.blocks_of(ranges.Recording(io.BytesIO(body)), begin, end, 640)]
        assert b"".join(b for _, b in blocks) == pcm and [f * 2 for f, _ in blocks] == np.cumsum([0, *(len(b) for _, b in blocks)])[:-1].tolist()
        assert all(first % 320 == 0 for first, _ in blocks)
    assert sum(len(p.parts) for p in wave.plan_ranges([(str(i), 10) for i in range(100)], 100)) == 100
    assert len(wave.plan_ranges([(str(i), 10) for i in range(100)], 100)) == 10


def test_pcm_source(spark, tmp_path):
    for name, (content, _) in WAVES.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / f"{name}.WAV").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x")
    (tmp_path / "long.wav").write_bytes(speech_wave("S..S"))
    rows = wave.read_pcm(spark, str(tmp_path), splitBytes=10_000).collect()
    errors = {os.path.basename(r.path)[:-4]: r.error for r in rows if r.error}
    assert errors == {n: e for n, (_, e) in WAVES.items() if e}
    long = sorted((r.first_sample, bytes(r.pcm)) for r in rows if r.path.endswith("long.wav"))
    assert b"".join(pcm for _, pcm in long) == speech_wave("S..S")[44:] and len(long) > 5
    levels = wave.scan_frames(wave.scan_wave(files.list_recordings(spark, str(tmp_path), "wav")), task_bytes=20_000)
    a = {(r.start_sample, r.end_sample, r.dbfs) for r in levels.filter("file_id LIKE '%long.wav'").collect()}
    blocks = wave.read_pcm(spark, str(tmp_path), splitBytes=9_999).filter("error IS NULL AND path LIKE '%long.wav'").withColumnRenamed("path", "file_id")
    assert a == {(r.start_sample, r.end_sample, r.dbfs) for r in frame_blocks(blocks).collect()} and len(a) == 200


def test_a_recording_that_fails_while_it_is_read(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.wav").write_bytes(speech_wave("S.S"))
    scanned = wave.scan_wave(files.list_recordings(spark, str(tmp_path), "wav"))
    layouts = spark.createDataFrame(scanned.collect(), scanned.schema)
    with open(tmp_path / "b.wav", "r+b") as cut:
        cut.truncate(40_000)
    rows = wave.scan_frames(layouts).collect()
    bad = {(os.path.basename(r.file_id), r.error) for r in rows if r.error}
    assert bad == {("b.wav", "the file ends inside its data")}
    assert sum(r.file_id.endswith("a.wav") for r in rows) == 150


def test_listing_finds_every_case_of_the_extension(spark, tmp_path):
    for name in ("b.MP4", "A.mp4", "sub/a.Mp4", "sub/deep/z.mP4", "no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = files.list_recordings(spark, str(tmp_path))
    assert [r.relative_path for r in files.ordered_listing(found).collect()] == ["A.mp4", "b.MP4", "sub/a.Mp4", "sub/deep/z.mP4"]


def test_frame_energy_of_samples_and_blocks_agree(spark):
    rng = np.random.default_rng(1)
    pcm = rng.integers(-32768, 32767, 1_000).astype("<i2")
    pcm[320:640] = 0
    blocks = [(1, i, bytearray(pcm[i : i + 640].tobytes())) for i in range(0, 1_000, 640)]
    a = frame_blocks(spark.createDataFrame(blocks, "file_id bigint, first_sample bigint, pcm binary")).orderBy("frame_idx").collect()
    samples = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(pcm)], "file_id bigint, idx bigint, s int")
    b = frame_samples(samples).orderBy("frame_idx").collect()
    assert [(x.start_sample, x.end_sample) for x in a] == [(x.start_sample, x.end_sample) for x in b] == [(0, 320), (320, 640), (640, 960), (960, 1_000)]
    assert all(abs(x.rms - y.rms) < 1e-9 for x, y in zip(a, b))
    assert a[1].dbfs == b[1].dbfs == float("-inf")
    loud = spark.createDataFrame([(1, 0, -32768)], "file_id bigint, idx bigint, s int")
    assert frame_samples(loud).first().dbfs == 0.0
    odd = spark.createDataFrame([(1, 0, bytearray(b"abc"))], "file_id bigint, first_sample bigint, pcm binary")
    with pytest.raises(Exception, match="odd byte count"):
        frame_blocks(odd).collect()


def speech_wave(pattern):
    rng = np.random.default_rng(len(pattern))
    parts = [rng.integers(-8_000 if c == "S" else -3, 8_000 if c == "S" else 4, 16_000).astype("<i2") for c in pattern]
    return riff(fmt(), chunk(b"data", np.concatenate(parts).tobytes()))


def test_bulk_transcription(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    recordings = {"a.wav": "..SS..S..", "sub/b.wav": "....", "sub/c.wav": "S.", "bad.wav": None, "boom.wav": ".SSSS."}
    for name, pattern in recordings.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"RIFFoops" if pattern is None else speech_wave(pattern))
    (out / "sub").mkdir(parents=True)
    (out / "sub" / "c.vtt").write_text("WEBVTT\n\nmine")
    listing = files.list_recordings(spark, str(root), "wav")
    work = plan_work(listing.select(F.col("path").alias("input_path"), "relative_path"), str(out))
    outputs = files.list_recordings(spark, str(out), "vtt").select("path", F.lit(False).alias("is_dir"))
    assert check_plan(work, outputs).count() == 0
    # Planned and gone when the batch runs.
    gone = spark.createDataFrame([(f"{root}/gone.wav", "gone.wav", f"{out}/gone.vtt")], work.schema)
    work = work.unionByName(gone)

    def recognise(model, pcm):
        seconds = len(pcm) // 32_000
        if seconds >= 4:
            raise RuntimeError("cannot recognise")
        return ["one", "", " ", "one two", f"one two {model} {seconds}"]

    result = transcribe(work, outputs, lambda: "--> é", recognise, task_bytes=40_000)
    jobs = {r.relative_path: (r.state, r.detail, r.cue_count) for r in result.jobs.collect()}
    assert jobs == {
        "a.wav": ("Complete", "Complete", 2),
        "sub/b.wav": ("Complete", "Complete", 0),
        "sub/c.wav": ("Complete", "Existing VTT skipped", 0),
        "bad.wav": ("Failed", "file is too short", 0),
        "boom.wav": ("Failed", "cannot recognise", 0),
        "gone.wav": ("Failed", "the recording is missing", 0),
    }
    for twice in (work.unionByName(gone), work.withColumn("relative_path", F.lit("../x.wav"))):
        with pytest.raises(ValueError, match="must not start"):
            transcribe(twice, outputs, lambda: None, recognise)
    decoded = transcribe(work, outputs, lambda: "--> é", recognise, decoder=lambda raw: b"" if raw.startswith(b"RIFFoops") else raw)
    assert {tuple(r) for r in decoded.jobs.collect()} == {tuple(r) for r in result.jobs.collect()}
    assert {tuple(r) for r in decoded.documents.collect()} == {tuple(r) for r in result.documents.collect()}
    cancelled = transcribe(work, outputs, lambda: "x", recognise, policy="cancel")
    assert {r.state for r in cancelled.jobs.collect()} == {"Cancelled"} and cancelled.documents.count() == 0
    written = {os.path.basename(r.output_path): r.disposition for r in sinks.write_vtt_files(result.documents, str(out)).collect()}
    assert written == {"a.vtt": "Written", "b.vtt": "Written"}
    assert (out / "sub" / "b.vtt").read_text() == "WEBVTT\n\n"
    assert (out / "sub" / "c.vtt").read_text() == "WEBVTT\n\nmine"
    lines = (out / "a.vtt").read_text(encoding="utf-8").split("\n")
    assert lines[0] == "WEBVTT" and lines[3] == "one two → é 2" and lines[6] == "one two → é 1"
    again = {r.disposition for r in sinks.write_vtt_files(result.documents, str(out)).collect()}
    assert again == {"SkippedExisting"}
    assert {r.disposition for r in sinks.write_vtt_files(result.documents, str(out), sinks.OVERWRITE).collect()} == {"Written"}
    assert not [n for _, _, names in os.walk(out) for n in names if n.endswith(".tmp")]
    texts = files.scan_vtt(spark, str(out))
    evidence = {r.relative_path: r for r in output_evidence(work, texts).collect()}
    assert evidence["sub/b.wav"].header_only and not evidence["a.wav"].header_only and not evidence["boom.wav"].exists


def test_scan_vtt_reports_bad_bytes_and_blocks(spark, tmp_path):
    (tmp_path / "x.vtt").write_bytes(b"WEBVTT\n\n\xff")
    (tmp_path / "y.vtt").write_text("WEBVTT\r\nid\r\n00:00:01.000 --> 00:00:02.000 align:left\r\nhello\r\nthere\r\n\r\n \r\n00:00:02.000 --> 00:00:03.000\r\nok", newline="")
    rows = {os.path.basename(r.path): r for r in files.scan_vtt(spark, str(tmp_path)).collect()}
    assert rows["x.vtt"].error and rows["x.vtt"].text is None
    docs = files.scan_vtt(spark, str(tmp_path)).filter("error IS NULL").select(F.lit(1).alias("file_id"), "text")
    cues = [tuple(r)[1:] for r in parse_documents(docs).orderBy("cue_no").collect()]
    assert cues == [(1, 1_000, 2_000, "hello there", None), (2, 2_000, 3_000, "ok", None)]
    assert document_errors(parse_documents(docs)).count() == 0


def test_manifest_of_a_synthetic_corpus_passes_its_rules(spark, tmp_path):
    rows = corpus(spark.range(9).select(F.col("id").alias("file_id")), seed=5).collect()
    assert rows == corpus(spark.range(9).select(F.col("id").alias("file_id")), seed=5).collect()
    silence = lambda n: {"samples": n, "seconds": n / 16_000}
    fixtures = []
    for r in rows:
        sha = f"{r.file_id:064x}"
        fixtures.append(
            {
                "fixtureId": str(r.file_id), "flatPath": f"flat/{r.file_id}.mp4", "nestedRelativePath": f"nested/a/{r.file_id}.mp4",
                "expectedVttPath": f"vtt/{r.file_id}.vtt", "sha256": sha, "masterPcmDataSha256": sha, "durationCoverageBand": r.band,
                "requestedTargetDurationSeconds": r.total_samples / 16_000, "masterDurationSamples": r.total_samples,
                "leadingSilence": silence(r.utterances[0].gap_before),
                "interUtteranceSilences": [silence(u.gap_before) for u in r.utterances[1:]],
                "trailingSilence": silence(r.trailing_silence),
                "utterances": [
                    {"authoredText": u.text + ".", "normalizedExpectedText": u.text, "startSample": u.start_sample, "endSample": u.end_sample,
                     "startSeconds": u.start_sample / 16_000, "endSeconds": u.end_sample / 16_000}
                    for u in r.utterances
                ],
            }
        )
    document = {
        "schemaVersion": 3, "generatorVersion": "1", "randomSeed": 2**64 - 1, "masterPcm": {"sampleRate": 16_000, "channels": 1, "bitsPerSample": 16},
        "vadTimingToleranceMilliseconds": 250, "fixtures": fixtures,
    }
    (tmp_path / "m.json").write_text(json.dumps(document, indent=1))
    read = manifest.scan_manifest(spark, str(tmp_path))
    assert read.first().randomSeed == 2**64 - 1
    fixture_rows, spoken = manifest.fixtures(read), manifest.utterances(read)
    assert header_rules(manifest.headers(read)).count() == 0
    assert fixture_rules(fixture_rows, spoken).count() == 0
    assert text_rules(spoken).count() == 0
    assert ground_truth_rules(fixture_rows, spoken).collect() == []
    assert manifest.silences(read).count() == spoken.count() + 9
    cues = spoken.select("file_id", (F.col("idx") + 1).alias("cue_no"), F.floor(F.col("start_sample") / 16).alias("start_ms"),
                         F.floor(F.col("end_sample") / 16).alias("end_ms"), "text", F.lit(None).cast("string").alias("error"))
    result = evaluate_documents(spoken.drop("gap_before"), cues).agg(F.sum("word_edits"), F.sum("produced_without_overlap")).first()
    assert tuple(result) == (0, 0)


def test_reports_are_not_replaced_unasked(spark, tmp_path):
    df = spark.range(3)
    sinks.write_report(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_report(df, str(tmp_path / "r"))
    sinks.write_report(df, str(tmp_path / "r"), overwrite=True)
    sinks.write_vtt_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_two_documents_of_one_path_are_refused(spark, tmp_path):
    rows = [("a", 0, "A0"), ("a", 1, "A1"), ("b", 0, "B"), ("b", 0, "other B"), ("b", 1, "B1"), ("c", 0, "C")]
    df = spark.createDataFrame([(f"{tmp_path}/{p}.vtt", n, t) for p, n, t in rows], "output_path string, part_no int, text string").coalesce(1)
    found = {os.path.basename(r.output_path): r.disposition for r in sinks.write_vtt_files(df, str(tmp_path)).collect()}
    assert found == {"a.vtt": "Written", "b.vtt": "Conflict", "c.vtt": "Written"}
    assert (tmp_path / "a.vtt").read_text() == "A0A1" and seen_below(tmp_path) == ["a.vtt", "c.vtt"]


def seen_below(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith(".disp"))


def failing(marker, times):
    """Fails after the rows went through, as often as there is no further marker file."""

    def wrap(rows):
        def run(batches):
            yield from batches
            for k in range(times):
                try:
                    open(f"{marker}-{k}", "x").close()
                except FileExistsError:
                    continue
                raise RuntimeError("lost")

        return rows.mapInArrow(run, rows.schema)

    return wrap


def test_a_job_that_fails_after_writing_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a.vtt", 0, "A"), ("sub/b.vtt", 0, "B"), ("n.vtt", 0, None)], "output_path string, part_no int, text string")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="lost"):
        keyed.write_keyed(rows, str(out), prepare=failing(tmp_path / "mark", 1))
    assert [n for _, _, names in os.walk(out) for n in names] == []
    # The next run of the same work finds nothing of the first.
    again = keyed.write_keyed(rows, str(out), prepare=failing(tmp_path / "mark", 1))
    assert {tuple(r) for r in again.collect()} == {("a.vtt", "Written"), ("sub/b.vtt", "Written"), ("n.vtt", "Written")}
    assert (out / "sub" / "b.vtt").read_text() == "B" and (out / "n.vtt").read_bytes() == b"" and seen_below(out) == ["a.vtt", "n.vtt", "sub"]
    assert {r.disposition for r in keyed.write_keyed(rows, str(out)).collect()} == {"SkippedExisting"}
    assert keyed.write_keyed(rows.limit(0), str(out)).collect() == []
    for path in ("../x.vtt", "/elsewhere/x.vtt", ""):
        with pytest.raises(Exception, match="leaves the root"):
            keyed.write_keyed(rows.withColumn("output_path", F.lit(path)).limit(1), str(out))
    assert seen_below(out) == ["a.vtt", "n.vtt", "sub"]


def test_a_task_that_runs_again_publishes_once(tmp_path):
    """Two attempts of a task stage the same keys; the message of one of them is committed."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array([0, 1, 0]), pa.array([b"A0", b"A1", b"B"])], ["k", "n", "c"])
    (tmp_path / ".staging").mkdir()
    options = {"path": str(tmp_path), "staging": f"{tmp_path}/.staging", "result": f"{tmp_path}/.dispositions/r.parquet"}
    writer = keyed.KeyedWriter(options)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.manifest != second.manifest and seen_below(tmp_path) == [".staging"]
    writer.commit([second, None, writer.write(iter([]))])
    assert (tmp_path / "a").read_bytes() == b"A0A1" and seen_below(tmp_path) == ["a", "b"]
    assert pq.read_table(options["result"])["disposition"].to_pylist() == ["Written", "Written"]


def test_published_by_tasks_and_again(spark, tmp_path):
    """The driver only says whose lists count; publishing what is published gives the same dispositions."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([0]), pa.array([b"A"])], ["k", "n", "c"])
    options = {"path": str(tmp_path), "staging": f"{tmp_path}/.staging", "result": f"{tmp_path}/r.parquet", "accepted": f"{tmp_path}/.staging/accepted.parquet"}
    writer = keyed.KeyedWriter(options)
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept])
    assert pq.read_table(options["accepted"])["manifest"].to_pylist() == [kept.manifest] != [lost.manifest] and seen_below(tmp_path) == [".staging"]
    rows = spark.createDataFrame([(f"d{k % 3}/{k}", 0, str(k)) for k in range(40)], "output_path string, part_no int, text string")
    assert {r.disposition for r in keyed.write_keyed(rows, str(tmp_path / "a")).collect()} == {"Written"}
    assert sorted(os.listdir(tmp_path / "a")) == [".dispositions", "d0", "d1", "d2"]
    system = pafs.LocalFileSystem()
    for n, mode in enumerate((keyed.FAIL_IF_EXISTS, keyed.OVERWRITE)):
        staged, target = str(tmp_path / f"s{n}"), str(tmp_path / f"x{n}" / "t")
        with open(staged, "w") as out:
            out.write("mine")
        assert [keyed._publish(system, staged, target, mode) for _ in range(2)] == ["Written", "Written"]
        with open(staged + "-other", "w") as out:
            out.write("other")
        assert keyed._publish(system, staged + "-other", target, mode) == ("SkippedExisting", "Written")[n]


def test_files_below_a_folder_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The same files as Spark's own reader finds, at any depth, and none of them known to the driver."""
    names = ["a.vtt", "x/b.vtt", "x/y/z/c d.vtt", "x/y/A=_1.vtt", "_k=1/e.vtt", "x/.hidden.vtt", ".staging/f.vtt", "_no/g.vtt", "x/h.VTT", "i.txt"]
    for name in [*names, *(f"many/{k}.vtt" for k in range(50))]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff" + name.encode() * (len(name) % 3))
    (tmp_path / "empty" / "deep").mkdir(parents=True)
    (tmp_path / "empty" / "j.vtt").touch()
    monkeypatch.setattr(files, "TASK_FILES", 7)
    found = files.read_below(spark, str(tmp_path), "vtt")
    known = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.vtt").load(str(tmp_path))
    known = sorted((r.path.removeprefix("file:"), bytes(r.content)) for r in known.collect())
    assert sorted((r.path, bytes(r.content)) for r in found.collect()) == known and len(known) == 55
    assert found.rdd.getNumPartitions() == 8 and not [f for f in found.inputFiles() if f.endswith(".vtt")]
    assert files.read_below(spark, str(tmp_path / "empty"), "vtt").collect() == []


def test_sink_dispositions_read_files_by_tasks(spark, tmp_path):
    rows = [(k, None if k == 5 else f"one\ntwee {k}", f"l{k % 3}") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["sink_dispositions"](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".vtt")]
    there = {r.output_path: r.disposition for r in found.filter("run = 0").collect()}
    texts = {f"l{k % 3}/{k}.vtt": (text or "").replace("\n", "").replace(*("eE" if k % 4 == 0 else "ee")) for k, text, _ in rows if text and (k % 3 == 0 or k % 4 == 0 or k % 10 != 7)}
    assert there == {path: hashlib.sha256(text.encode()).hexdigest() for path, text in texts.items()}


def test_short_ranges_are_packed():
    files = [(str(k), 250) for k in range(100)]
    parts = wave.plan_ranges(files, 100, 1_000)
    assert len(parts) <= 34 and sorted(r for p in parts for r in p.parts) == sorted(r for p in wave.plan_ranges(files, 100) for r in p.parts)


def test_wave_frames_cut_recordings_apart(spark, tmp_path, monkeypatch):
    """Texts of a few frames are read in several ranges each, cut inside frames, and have every frame once."""
    texts = {k: ("zoë says %d " % k) * (40 * k) for k in range(14)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    readers, plain = [], wave.read_pcm

    def seen(session, folder, **options):
        readers.append(wave.PcmReader({"path": folder, **{k: str(v) for k, v in options.items()}}))
        return plain(session, folder, **options)

    monkeypatch.setattr(wave, "read_pcm", seen)
    found = {(r.file_id, r.frame_idx): (r.start_sample, r.end_sample, r.rms) for r in QUERIES["wave_frames"](spark, str(tmp_path)).collect()}
    ranges_of = [(os.path.basename(r[0]), *r[1:]) for part in readers[0].partitions() for r in part.parts]
    assert all(end - begin <= 1_000 for _, _, begin, end in ranges_of) and len({r[0] for r in ranges_of}) == 14
    cut = {name for name, _, begin, _ in ranges_of if begin and (begin - 44) % 640}
    assert cut == {f"{k}.wav" for k in texts if k}
    expected = {}
    for k, text in texts.items():
        if k % 13 != 1 and k % 7 != 3 and k % 11 != 5:
            raw = text.encode()
            pcm = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype("float")
            for n in range(0, pcm.size, 320):
                piece = pcm[n : n + 320]
                expected[str(k), n // 320] = (n, n + piece.size, round(float(np.sqrt((piece**2).mean())), 4))
    assert found == expected and len(found) > 50


def test_plans_do_not_grow_with_short_ranges():
    files = [(f"{k}.wav", 3_000) for k in range(1_000)]
    short, whole = (wave.plan_ranges(files, split, 1 << 20) for split in (7, 3_000))
    assert sum(len(pickle.dumps(p)) for p in short) < 1.1 * sum(len(pickle.dumps(p)) for p in whole) < 60 * len(files)
    assert sum(1 for p in short for _ in p.ranges()) == 1_000 * 429


def test_blocks_are_scored_together(spark):
    """Blocks of any length, empty ones too, give what each gives alone, whatever file it is of."""
    rng = np.random.default_rng(3)
    blocks = [(f"f{k % 3}", 320 * k, bytearray(rng.integers(-9_000, 9_000, n).astype("<i2").tobytes())) for k, n in enumerate((320, 5, 0, 960, 641, 1, 320))]
    found = sorted(tuple(r) for r in frame_blocks(spark.createDataFrame(blocks, "file_id string, first_sample bigint, pcm binary").coalesce(1)).collect())
    alone = [(file, *row) for file, first, pcm in blocks for row in zip(*(c.to_pylist() for c in score_pcm(bytes(pcm), first, 320)))]
    assert found == sorted(alone) and len(found) == 10


def test_table_sink_by_key(spark, tmp_path):
    schema, path = "output_path string, part_no int, text string", str(tmp_path / "table")
    one = spark.createDataFrame([("a", 0, "A"), ("a", 1, "A1"), ("b", 0, "x"), ("b", 0, "y")], schema)
    assert {tuple(r) for r in sinks.add_to_vtt_table(one, path).collect()} == {("a", "Written"), ("b", "Conflict")}
    two = spark.createDataFrame([("a", 0, "new"), ("b", 0, "z")], schema)
    assert {tuple(r) for r in sinks.add_to_vtt_table(two, path).collect()} == {("a", "SkippedExisting"), ("b", "Written")}
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["A", "A1", "z"]


def test_nested_report(spark):
    corpus = spark.createDataFrame([(2, 0.5)], "recordings long, percent double")
    recordings = spark.createDataFrame([(1, 0.1), (2, None)], "file_id long, percent double")
    details = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "file_id long, idx int, text string")
    found = {r.file_id: r for r in sinks.nested_report(corpus, recordings, details).collect()}
    assert [d.text for d in found[1].details] == ["a", "b"] and found[2].details is None and found[2].corpus.recordings == 2


def test_reports_of_an_empty_corpus_and_in_parts(spark):
    corpus = spark.createDataFrame([], "recordings long, percent double")
    recordings = spark.createDataFrame([(1,), (2,)], "file_id long")
    details = spark.createDataFrame([(1, k, f"t{k}") for k in range(5)], "file_id long, idx int, text string")
    found = {(r.file_id, r.part_no): r for r in sinks.nested_report(corpus, recordings, details, part_rows=2).collect()}
    assert found.keys() == {(1, 0), (1, 1), (1, 2), (2, 0)} and all(r.corpus is None for r in found.values())
    assert [d.text for d in found[1, 2].details] == ["t4"] and found[2, 0].details is None
