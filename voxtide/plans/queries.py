"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtide.functions import paths as fp
from voxtide.functions import scalars as fs
from voxtide.functions import text as ft
from voxtide.functions import timecode as tc
from voxtide.operators import audit, frames, intervals, jobs, listing, quality, speech, synth, transcripts
from voxtide.operators import cues as cue_ops
from voxtide.operators.ordered import blocked_by, row_index, spread
from voxtide.plans import evaluate, transcribe, views
from voxtide.sources import wave
from voxtide.streaming import runs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and text -------------------------------------------------------------------------------------------


@query
def list_recordings(spark, sf):
    found = views.recordings(spark, sf).select("doc_id", "relative_path", "length")
    return listing.ordered_paths(found)


@query
def content_hash(spark, sf):
    content = F.encode("text", "UTF-8")
    rows = views.table(spark, sf, "documents").select("doc_id", content.alias("c"))
    offset = F.lit(2)
    length = F.greatest(F.length("c") - 5, F.lit(0))
    return rows.select("doc_id", ft.sha256_hex(F.col("c")).alias("sha"), ft.data_sha256_hex(F.col("c"), offset, length).alias("data_sha"))


@query
def output_paths(spark, sf):
    rows = views.listing(spark, sf)
    return rows.select(
        "doc_id",
        fp.relative_path(F.col("path"), "/in").alias("relative"),
        fp.relative_output_path(F.col("relative_path")).alias("output"),
        fp.path_depth(F.col("relative_path")).alias("depth"),
    )


@query
def escaping_paths(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ("", "../", "a/../../", "./", "/", "..\\", "a/../"))), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = views.listing(spark, sf).select("doc_id", F.concat(prefix, "relative_path").alias("relative_path"))
    return rows.select("doc_id", "relative_path", fp.escapes_root(F.col("relative_path")).alias("escapes"))


@query
def windows_safe_paths(spark, sf):
    path = F.regexp_replace("url", "^https?://", "")
    names = F.element_at(F.array(*map(F.lit, ("", "/con", "/Aux.txt", "/com1.a.b", "/x.", "/lpt9"))), (F.col("page_id") % 6 + 1).cast("int"))
    rows = views.table(spark, sf, "pages").select("page_id", F.concat(path, names).alias("path"))
    return rows.select("page_id", fp.windows_safe_path(F.col("path")).alias("safe"))


@query
def interval_bounds(spark, sf):
    rows = views.detected(spark, sf)
    start, end = F.col("start_sample") - 6_000, F.col("end_sample") - 6_000
    total = F.lit(300_000)
    return rows.select(
        "file_id",
        "idx",
        fs.is_valid_interval(start, end).alias("valid"),
        fs.clamp_interval(start, end, total)["start_sample"].alias("clamped_start"),
        fs.clamp_interval(start, end, total)["end_sample"].alias("clamped_end"),
    )


@query
def timecodes(spark, sf):
    rows = views.cues(spark, sf)
    ms = tc.samples_to_ms(F.col("start_sample") * 97 + F.col("cue_idx"))
    shown = rows.select("file_id", "cue_idx", ms.alias("ms")).withColumn("shown", tc.format_timestamp(F.col("ms")))
    return shown.select("file_id", "cue_idx", "ms", "shown", tc.ms_to_samples(tc.parse_timestamp(F.col("shown"))).alias("samples"))


@query
def parse_timestamps(spark, sf):
    """Well-formed and broken timestamps."""
    good = tc.format_timestamp(F.col("event_id") * 3_777)
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.substring(good, 2, 20))
        .when(kind == 1, F.replace(good, F.lit("."), F.lit(",")))
        .when(kind == 2, F.concat(good, F.lit("0")))
        .when(kind == 3, F.regexp_replace(good, ":[0-9]{2}[.]", ":61."))
        .otherwise(good)
    )
    rows = views.table(spark, sf, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", "text", tc.parse_timestamp(F.col("text")).alias("ms"))


@query
def sanitized_text(spark, sf):
    text = F.concat(F.lit("\t "), F.replace("text", F.lit("."), F.lit(" --> ")))
    text = F.when(F.col("doc_id") % 41 == 0, F.lit(" \n")).otherwise(F.concat(text, F.lit("é")))
    return views.documents(spark, sf).select("doc_id", ft.sanitize_text(text).alias("text"))


@query
def normalized_text(spark, sf):
    text = F.concat(F.lit(" "), "text", F.lit("\r\n +$ — « Q»"))
    return views.documents(spark, sf).select("doc_id", ft.normalize_text(text).alias("text"))


@query
def tokens(spark, sf):
    rows = spread(views.table(spark, sf, "pages").select("page_id", "html")).select("page_id", ft.tokenize(F.col("html")).alias("t"))
    return rows.select("page_id", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query
def compact_messages(spark, sf):
    return views.documents(spark, sf).select("doc_id", ft.compact_message(F.col("text")).alias("message"))


@query
def vtt_headers(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("WEBVTT", "﻿WEBVTT ", "WEBVTTX", " WEBVTT", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("\n")).otherwise(F.col("text"))
    rows = views.table(spark, sf, "documents").select("doc_id", F.concat(lead, body).alias("text"))
    return rows.select(
        "doc_id",
        ft.has_vtt_header(F.col("text"), strict=False).alias("prefix"),
        ft.has_vtt_header(F.col("text")).alias("strict"),
        ft.is_header_only(F.col("text")).alias("header_only"),
    )


@query
def strict_utf8(spark, sf):
    content = F.encode("text", "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("C328")))
    content = F.when(F.col("doc_id") % 7 == 0, broken).otherwise(content)
    rows = views.table(spark, sf, "documents").select("doc_id", content.alias("c")).select("doc_id", ft.strict_utf8(F.col("c")).alias("r"))
    return rows.select("doc_id", "r.text", "r.error")


@query
def sha256_shapes(spark, sf):
    digest = F.sha2("text", 256)
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.upper(digest)).when(kind == 1, F.substring(digest, 2, 64)).when(kind == 2, F.concat(F.lit("g"), F.substring(digest, 2, 63))).otherwise(digest)
    return views.table(spark, sf, "documents").select("doc_id", ft.is_sha256(text).alias("ok"))


@query
def safe_percentages(spark, sf):
    docs = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.groupBy("source", "lang").agg(F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))
    return rows.select("source", "lang", fs.safe_percent(F.col("good"), F.col("labelled")).alias("percent"))


@query
def normalized_progress(spark, sf):
    return views.job_events(spark, sf).select("seq", fs.normalize_progress(F.col("progress")).alias("progress"))


@query
def durations_shown(spark, sf):
    return views.table(spark, sf, "events").select("event_id", tc.format_duration((F.col("value") - 5) * 60).alias("shown"))


@query
def stage_progress(spark, sf):
    rows = views.job_events(spark, sf)
    return rows.select("seq", F.round(fs.stage_progress(F.col("stage"), F.col("progress")), 9).alias("progress"))


@query
def transcribe_progress(spark, sf):
    rows = intervals.stage_timeline(views.utterances(spark, sf))
    return rows.select("file_id", "idx", F.round("progress_before", 9).alias("progress_before"), F.round("progress_after", 9).alias("progress_after"))


# --- frames and speech ------------------------------------------------------------------------------------------


@query
def frame_energy(spark, sf):
    rows = frames.frame_samples(views.samples(spark, sf), 4)
    return rows.select("file_id", "frame_idx", "start_sample", "end_sample", F.round("rms", 6).alias("rms"), F.round("dbfs", 6).alias("dbfs"))


@query
def wave_layouts(spark, sf):
    """Layouts of files, from their first bytes; two paths have no file."""
    paths, folder = views.landed(views.wave_files(spark, sf), "waves")
    gone = spark.range(2).select(F.concat(F.lit(folder + "/gone-"), F.col("id").cast("string")).alias("path"))
    scanned = wave.scan_wave(paths.select("path").union(gone))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]wav$", "")
    return scanned.select(name.alias("path"), "sample_rate", "data_offset", "data_length", "sample_count", "error")


@query
def quarantined_recordings(spark, sf):
    paths, _ = views.landed(views.wave_files(spark, sf), "waves")
    _, bad = quality.split_quarantine(wave.scan_wave(paths))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("files"))


@query
def wave_frames(spark, sf):
    """Frame energies straight from the recordings' bytes, read in ranges of some hundred bytes that cut frames apart."""
    _, folder = views.landed(views.wave_files(spark, sf), "waves")
    blocks = wave.read_pcm(spark, folder, splitBytes=501).filter("error IS NULL").withColumnRenamed("path", "file_id")
    name = F.regexp_replace(F.element_at(F.split("file_id", "/"), -1), "[.]wav$", "")
    rows = frames.frame_blocks(blocks)
    return rows.select(name.alias("file_id"), "frame_idx", "start_sample", "end_sample", F.round("rms", 4).alias("rms"))


@query
def pcm_hashes(spark, sf):
    """SHA-256 of the data range alone."""
    paths, _ = views.landed(views.wave_files(spark, sf), "waves")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]wav$", "")
    return wave.data_hashes(wave.scan_wave(paths)).select(name.alias("path"), "pcm_sha")


def _bulk(spark, sf, policy="skip"):
    """Recordings to caption documents, with a recogniser that says how much it heard and fails on some lengths."""
    paths, folder = views.landed(views.tone_files(spark, sf), "tones")
    gone = spark.range(1).select(F.lit(folder + "/gone.wav").alias("path"), F.lit("gone.wav").alias("relative_path"))
    work = listing.plan_work(paths.union(gone).select(F.col("path").alias("input_path"), "relative_path"), "/out")
    existing = work.filter("relative_path RLIKE '[05][.]wav$'").select(
        F.replace("output_path", F.lit("/out/"), F.lit("/OUT/")).alias("path"), F.lit(False).alias("is_dir")
    )

    def recognise(model, pcm):
        if len(pcm) % 13 == 5:
            raise RuntimeError("cannot recognise")
        return [model, f"{model} {len(pcm) // 2} samples"]

    return transcribe.transcribe(work, existing, lambda: "heard", recognise, policy, task_bytes=1 << 20)


@query
def bulk_transcription(spark, sf):
    return _bulk(spark, sf).documents.select("output_path", "part_no", "text", "cue_count")


@query
def bulk_jobs(spark, sf):
    """The state of every work item: complete, skipped, or failed for one of four reasons; and of a cancelled batch."""
    jobs = _bulk(spark, sf).jobs.withColumn("policy", F.lit("skip"))
    return jobs.unionByName(_bulk(spark, sf, "cancel").jobs.withColumn("policy", F.lit("cancel")))


@query
def sink_dispositions(spark, sf):
    """Caption files written twice over: new ones, ones that are there, and two documents of one path."""
    from voxtide.sources import files, sinks
    from voxtide.streaming.runs import new_folder

    folder = new_folder(spark, "captions")
    docs = views.table(spark, sf, "documents").select("doc_id", F.format_string("%s/%d.vtt", "lang", "doc_id").alias("output_path"), "text")
    parts = docs.select("doc_id", "output_path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("part_no", "text"))
    first = sinks.write_vtt_files(parts.filter("doc_id % 3 = 0"), folder)
    twice = parts.filter("doc_id % 10 = 7")
    second = sinks.write_vtt_files(parts.unionByName(twice), folder)
    third = sinks.write_vtt_files(parts.filter("doc_id % 4 = 0").withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), folder, sinks.OVERWRITE)
    runs_of = [rows.select(F.lit(n).alias("run"), "*") for n, rows in enumerate((first, second, third), 1)]
    found = runs_of[0].unionByName(runs_of[1]).unionByName(runs_of[2])
    there = files.read_below(spark, folder, "vtt")
    name = F.regexp_extract("path", "[^/]+/[^/]+$", 0)
    there = there.select(F.lit(0).alias("run"), name.alias("output_path"), F.sha2("content", 256).alias("disposition"))
    return found.unionByName(there)


@query
def classified_frames(spark, sf):
    return frames.classify(views.frames(spark, sf), views.FIXED).select("file_id", "frame_idx", "above", "below")


@query
def frame_violations(spark, sf):
    """Frames made wrong here and there."""
    at = F.col("frame_idx") + F.col("file_id")
    rows = views.frames(spark, sf).select(
        "file_id",
        "frame_idx",
        (F.col("start_sample") + F.when(at % 37 == 0, 10).otherwise(0)).alias("start_sample"),
        (F.col("end_sample") - F.when(at % 41 == 0, 320).otherwise(0)).alias("end_sample"),
        F.when(at % 43 == 0, F.lit(float("nan"))).otherwise(F.col("dbfs")).alias("dbfs"),
    )
    return frames.check_frames(rows)


def _marked(spark, sf):
    return frames.classify(views.frames(spark, sf), views.FIXED)


@query
def latch_states(spark, sf):
    return speech.latch(_marked(spark, sf), views.FIXED).select("file_id", "frame_idx", "in_speech")


@query
def speech_islands(spark, sf):
    return speech.islands(_marked(spark, sf), views.FIXED).select("file_id", "core_start", "voiced_end", "close_sample", "closed")


@query
def padded_pieces(spark, sf):
    stretches = speech.islands(_marked(spark, sf), views.FIXED)
    return speech.natural_pieces(stretches, views.FIXED).select("file_id", "start_sample", "end_sample")


@query
def detect_fixed(spark, sf):
    """Detection with fixed thresholds and no maximum length: one shuffle, all in the JVM."""
    return speech.detect_speech(views.frames(spark, sf), views.FIXED, adaptive=False)


@query
def detect_capped(spark, sf):
    return speech.detect_speech(views.frames(spark, sf), views.CAPPED, adaptive=False)


@query
def detect_adaptive(spark, sf):
    return speech.detect_speech(views.frames(spark, sf), views.ADAPTIVE)


@query
def split_pieces(spark, sf):
    return speech.speech_pieces(views.frames(spark, sf), views.CAPPED, adaptive=False).filter("kind <> 'natural'")


@query
def failed_recordings(spark, sf):
    """Timings under which the pre-roll reaches back over the interval before, so that a forced piece can vanish."""
    pieces = speech.speech_pieces(views.frames(spark, sf), views.BREAKING, adaptive=False)
    return speech.failed_files(pieces, views.BREAKING)


# --- intervals --------------------------------------------------------------------------------------------------


@query
def interval_violations(spark, sf):
    at = F.col("file_id") + F.col("idx")
    rows = views.utterances(spark, sf).select(
        "file_id",
        "idx",
        (F.col("start_sample") - F.when(at % 9 == 0, 9_000).otherwise(0)).alias("start_sample"),
        (F.col("end_sample") + F.when(at % 10 == 0, 500_000).otherwise(0)).alias("end_sample"),
    )
    totals = views.utterances(spark, sf).groupBy("file_id").agg(F.max("end_sample").alias("total_samples"))
    return intervals.check_sequence(rows, totals)


@query
def overlap_pairs(spark, sf):
    rows = intervals.overlap_pairs(views.utterances(spark, sf), views.detected(spark, sf))
    return rows.select("file_id", "a_idx", "b_idx")


@query
def best_matches(spark, sf):
    return intervals.best_matches(views.utterances(spark, sf), views.detected(spark, sf), 100)


@query
def boundary_errors(spark, sf):
    rows = intervals.best_matches(views.utterances(spark, sf), views.detected(spark, sf), 100).filter("detected_start IS NOT NULL")
    return rows.groupBy("file_id").agg(
        intervals.exact_median(F.col("abs_start_error")).alias("median_start"),
        intervals.exact_median(F.col("abs_end_error")).alias("median_end"),
        F.min("start_error").alias("earliest"),
        F.max("end_error").alias("latest"),
    )


@query
def produced_without_overlap(spark, sf):
    return intervals.without_overlap(views.detected(spark, sf), _shortened(spark, sf)).select("file_id", "idx")


@query
def expected_without_overlap(spark, sf):
    return intervals.without_overlap(views.utterances(spark, sf), views.detected(spark, sf)).select("file_id", "idx")


def _shortened(spark, sf):
    """Every third utterance, so that some detected intervals meet nothing."""
    return views.utterances(spark, sf).filter("(file_id + idx) % 3 = 0")


@query
def total_speech(spark, sf):
    return intervals.total_length(views.detected(spark, sf))


@query
def true_positive_samples(spark, sf):
    return intervals.overlap_samples(views.utterances(spark, sf), views.detected(spark, sf))


@query
def detection_metrics(spark, sf):
    return evaluate.evaluate_detection(views.utterances(spark, sf), views.detected(spark, sf), 100, 40_000)


@query
def detection_corpus(spark, sf):
    return intervals.corpus_metrics(views.utterances(spark, sf), views.detected(spark, sf), 100, 40_000)


@query
def sequence_equality(spark, sf):
    shifted = views.utterances(spark, sf).withColumn("end_sample", F.col("end_sample") + F.when((F.col("file_id") + F.col("idx")) % 6 == 0, 1).otherwise(0))
    return intervals.sequences_equal(views.utterances(spark, sf), shifted)


@query
def interval_chunks(spark, sf):
    return intervals.chunk_intervals(views.utterances(spark, sf))


# --- cues and transcripts ---------------------------------------------------------------------------------------


@query
def timeline(spark, sf):
    return views.utterances(spark, sf).select("file_id", "idx", "start_sample", "end_sample")


def _rough_cues(spark, sf):
    """Cues with overlaps, sub-millisecond lengths, blanks and invalid ranges."""
    at = F.col("file_id") + F.col("cue_idx") * 3
    return views.cues(spark, sf).select(
        "file_id",
        "cue_idx",
        (F.col("start_sample") - F.when(at % 4 == 0, 12_000).otherwise(0)).alias("start_sample"),
        F.when(at % 5 == 0, F.col("start_sample") + 3).otherwise(F.col("end_sample")).alias("end_sample"),
        F.when(at % 13 == 0, F.lit(" \t")).otherwise(F.col("text")).alias("text"),
    )


@query
def clamped_cues(spark, sf):
    return cue_ops.clamp_cues(_rough_cues(spark, sf))


@query
def vtt_documents(spark, sf):
    cues = _rough_cues(spark, sf)
    files = cues.select("file_id").distinct()
    # Cues without text are dropped by the operator: every sixth recording has no others.
    silent = cues.withColumn("text", F.when(F.col("file_id") % 6 == 1, " ").otherwise(F.col("text")))
    return cue_ops.assemble_documents(cue_ops.clamp_cues(silent), files)


@query
def vtt_round_trip(spark, sf):
    documents = cue_ops.assemble_documents(cue_ops.clamp_cues(_rough_cues(spark, sf)), part_cues=3)
    return cue_ops.parse_documents(documents).select("file_id", "cue_no", "start_ms", "end_ms", "text", "error")


@query
def document_diagnostics(spark, sf):
    """Transcripts held against their own captions, in parts of two cues; every fifth document lacks its header."""
    spoken = views.utterances(spark, sf)
    cues = spoken.select("file_id", F.col("idx").alias("cue_idx"), "start_sample", "end_sample", "text")
    documents = cue_ops.assemble_documents(cue_ops.clamp_cues(cues), part_cues=2)
    headless = (F.col("file_id") % 5 == 0) & (F.col("part_no") == 0)
    documents = documents.withColumn("text", F.when(headless, F.concat(F.lit("no "), "text")).otherwise(F.col("text")))
    return evaluate.evaluate_documents(spoken, cue_ops.parse_documents(documents))


@query
def evaluate_files(spark, sf):
    """Caption files on storage against what was said: some lack their header, some are missing, some cues have a word more."""
    from voxtide.sources import sinks
    from voxtide.streaming.runs import new_folder

    folder = new_folder(spark, "produced")
    spoken = views.utterances(spark, sf)
    text = F.when((F.col("file_id") % 4 == 1) & (F.col("idx") % 2 == 0), F.concat("text", F.lit(" indeed"))).otherwise(F.col("text"))
    cues = spoken.select("file_id", F.col("idx").alias("cue_idx"), "start_sample", "end_sample", text.alias("text"))
    documents = cue_ops.assemble_documents(cue_ops.clamp_cues(cues), part_cues=2)
    headless = (F.col("file_id") % 5 == 0) & (F.col("part_no") == 0)
    documents = documents.withColumn("text", F.when(headless, F.concat(F.lit("no "), "text")).otherwise(F.col("text")))
    path = F.format_string("to/%d.vtt", "file_id")
    sinks.write_vtt_files(documents.filter("file_id % 7 <> 2").withColumn("output_path", path), folder).count()
    names = spoken.select("file_id").distinct().withColumn("relative_path", path)
    report = evaluate.evaluate_files(folder, names, spoken)
    figures = ("expected_words", "actual_words", "word_edits", "word_edit_percent")
    rows = report.recordings.select(F.lit("recording").alias("part"), "file_id", F.lit(None).cast("bigint").alias("idx"), F.col("error").alias("note"), *figures)
    differ = report.disagreements.select(F.lit("cue").alias("part"), "file_id", F.col("idx").cast("bigint").alias("idx"), F.col("rule").alias("note"))
    corpus = report.corpus.select(F.lit("corpus").alias("part"), F.col("worst_file_id").alias("file_id"), F.col("recordings").alias("idx"), *figures)
    return rows.unionByName(differ, allowMissingColumns=True).unionByName(corpus, allowMissingColumns=True)


@query
def nested_reports(spark, sf):
    """A report written and read back: utterances nested in their recordings, three to a document."""
    from voxtide.sources import sinks
    from voxtide.streaming.runs import new_folder

    folder = new_folder(spark, "report")
    spoken = views.utterances(spark, sf)
    recordings = spoken.groupBy("file_id").agg(F.count(F.lit(1)).alias("utterances"))
    corpus = recordings.agg(F.count(F.lit(1)).alias("recordings"), F.sum("utterances").alias("utterances"))
    sinks.write_report(sinks.nested_report(corpus, recordings, spoken.select("file_id", "idx", "text"), part_rows=3), folder)
    texts = F.transform("details", lambda d: F.concat(d["idx"].cast("string"), F.lit(":"), d["text"]))
    return spark.read.json(folder).select(
        "file_id", "part_no", "utterances", F.col("corpus.recordings").alias("recordings"), F.col("corpus.utterances").alias("corpus_utterances"), F.array_join(texts, "|").alias("texts")
    )


@query
def vtt_errors(spark, sf):
    """Documents broken in known ways."""
    documents = cue_ops.assemble_documents(cue_ops.clamp_cues(_rough_cues(spark, sf)), part_cues=2)
    documents = documents.withColumn("_last", F.max("part_no").over(Window.partitionBy("file_id")) == F.col("part_no"))
    first_part, kind = F.col("part_no") == 0, F.col("file_id") % 5
    first = r"(?s)\A(WEBVTT\n\n)([^\n]*)\n([^\n]*)\n"
    text = (
        F.when((kind == 0) & first_part, F.concat(F.lit("X"), "text"))
        .when((kind == 1) & first_part, F.regexp_replace("text", first, "$1no time\n$3\n"))
        .when((kind == 2) & first_part, F.regexp_replace("text", first, "$1$2\n\n"))
        .when((kind == 3) & F.col("_last"), F.concat("text", F.lit("00:00:00.000 --> 00:00:00.001\nlate\n")))
        .when(kind == 4, F.concat(F.when(first_part, "﻿").otherwise(""), F.replace("text", F.lit("\n"), F.lit("\r\n"))))
        .otherwise(F.col("text"))
    )
    parsed = cue_ops.parse_documents(documents.select("file_id", "part_no", text.alias("text")))
    return cue_ops.document_errors(parsed)


@query
def regressing_cues(spark, sf):
    cues = _rough_cues(spark, sf).select(
        "file_id",
        (F.col("cue_idx") + 1).alias("cue_no"),
        F.col("start_sample").alias("start_ms"),
        F.col("end_sample").alias("end_ms"),
    )
    return cue_ops.regressing_cues(cues)


@query
def cue_agreement(spark, sf):
    spoken = views.utterances(spark, sf)
    cues = cue_ops.clamp_cues(_rough_cues(spark, sf))
    return transcripts.cue_agreement(spoken, cues)


def _edited_words(spark, sf):
    """Documents against a copy that lost every seventh word and had every fifth replaced."""
    words = views.documents(spark, sf).select("doc_id", ft.tokenize(F.col("text")).alias("e"))
    numbered = F.transform("e", lambda t, i: F.struct(F.when(i % 5 == 4, F.lit("#")).otherwise(t).alias("t"), i.alias("i")))
    return words.withColumn("a", F.transform(F.filter(numbered, lambda w: w["i"] % 7 != 6), lambda w: w["t"]))


@query
def word_edits(spark, sf):
    rows = _edited_words(spark, sf)
    return rows.select("doc_id", F.size("e").alias("words"), transcripts.word_edits(F.col("e"), F.col("a")).alias("edits"))


@query
def transcript_diagnostics(spark, sf):
    return evaluate.evaluate_transcripts(views.utterances(spark, sf), views.detected(spark, sf))


@query
def transcript_rollup(spark, sf):
    return transcripts.transcript_rollup(evaluate.evaluate_transcripts(views.utterances(spark, sf), views.detected(spark, sf)))


@query
def accumulated_transcripts(spark, sf):
    return transcripts.accumulate_transcripts(views.responses(spark, sf))


@query
def emission_gaps(spark, sf):
    return transcripts.emission_gaps(views.responses(spark, sf).filter("(session_id + seq) % 5 <> 3"))


@query
def push_metrics(spark, sf):
    pushes = views.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), (F.col("value") > 80).alias("waited"), F.floor("value").cast("bigint").alias("elapsed_ms")
    )
    return transcripts.push_metrics(pushes)


# --- listings ---------------------------------------------------------------------------------------------------


@query
def existing_outputs(spark, sf):
    return listing.existing_outputs(views.work(spark, sf), views.outputs(spark, sf))


@query
def conflicting_directories(spark, sf):
    return listing.conflicting_directories(views.work(spark, sf), views.outputs(spark, sf))


@query
def pending_skip(spark, sf):
    return listing.pending_work(views.work(spark, sf), views.outputs(spark, sf), "skip")


@query
def pending_overwrite(spark, sf):
    return listing.pending_work(views.work(spark, sf), views.outputs(spark, sf), "overwrite")


@query
def pending_cancel(spark, sf):
    return listing.pending_work(views.work(spark, sf), views.outputs(spark, sf), "cancel")


@query
def output_collisions(spark, sf):
    """Every document in two containers, or with a name that differs in case only, maps to one output."""
    rows = views.recordings(spark, sf).select(F.col("path").alias("input_path"), "relative_path")
    twin = rows.select(
        F.concat("input_path", F.lit("2")).alias("input_path"), F.upper("relative_path").alias("relative_path")
    ).filter("length(relative_path) % 2 = 0")
    return listing.output_collisions(listing.plan_work(rows.unionByName(twin), "/out"))


@query
def missing_listing(spark, sf):
    work = views.work(spark, sf).select("relative_path", F.col("output_path").alias("path"))
    return listing.missing_paths(work, views.outputs(spark, sf))


@query
def listing_differences(spark, sf):
    work = views.work(spark, sf).select(F.col("output_path").alias("path"))
    return listing.set_differences(views.outputs(spark, sf).select("path"), work)


@query
def stale_artifacts(spark, sf):
    name = F.concat(
        F.lit("/out/"),
        F.when(F.col("event_id") % 3 == 0, F.lit("keep")).otherwise(F.lit("")),
        F.lit(listing.TEMPORARY_PREFIX),
        F.when(F.col("event_id") % 4 == 0, F.lit("zz")).otherwise(F.lit("")),
        F.md5(F.col("event_id").cast("string")),
        F.lit(listing.TEMPORARY_SUFFIX),
    )
    files = views.table(spark, sf, "events").select("event_id", name.alias("path"), F.lit(False).alias("is_dir"), F.col("ts").alias("modified"))
    return listing.stale_artifacts(files, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "path")


@query
def discovery_summary(spark, sf):
    found = views.recordings(spark, sf)
    issues = views.listing(spark, sf).filter("is_dir").select("path", F.lit("access denied").alias("reason"))
    return listing.discovery_summary(found, issues)


# --- jobs -------------------------------------------------------------------------------------------------------


@query
def illegal_transitions(spark, sf):
    return jobs.illegal_transitions(views.job_events(spark, sf))


@query
def current_jobs(spark, sf):
    return jobs.current_jobs(views.job_events(spark, sf))


@query
def cancelled_jobs(spark, sf):
    # Most ends are taken for running work, so that there is something left to cancel.
    ends = F.col("state").isin("Complete", "Failed") & ((F.col("seq") + F.col("job_id")) % 97 != 0)
    events = views.job_events(spark, sf).withColumn("state", F.when(ends, "Transcribing").otherwise(F.col("state")))
    cancels = events.filter("value > 150").select("batch_id")
    return jobs.cancel_cascade(jobs.current_jobs(events), cancels).select("batch_id", "job_id", "state")


@query
def batch_snapshots(spark, sf):
    return jobs.batch_snapshot(views.job_events(spark, sf))


@query
def first_stages(spark, sf):
    return jobs.first_stage(views.job_events(spark, sf), "Transcribing")


@query
def monotone_progress(spark, sf):
    return jobs.monotone_progress(views.job_events(spark, sf)).select("job_id", "seq", "shown_progress")


@query
def stage_reports(spark, sf):
    return jobs.drop_late_progress(views.job_events(spark, sf)).select("job_id", "seq", "stage")


@query
def rolling_durations(spark, sf):
    rows = views.job_events(spark, sf).select(
        "batch_id", "seq", F.floor((F.col("value") - 5) * 100).cast("bigint").alias("duration_ms"), (F.col("job_id") % 4 - 1).alias("remaining")
    )
    return jobs.rolling_durations(rows, ["batch_id"])


@query
def throttled_events(spark, sf):
    """Publication with a ten-minute interval, which suits the spacing of the events."""
    events = views.job_events(spark, sf).withColumn("forced", F.col("seq") % 11 == 0)
    return jobs.throttle(events, interval_ms=600_000)


@query
def latest_snapshots(spark, sf):
    rows = views.job_events(spark, sf).withColumn("generation", F.col("seq") % 3)
    return jobs.latest_snapshots(rows, ["job_id"], ["state", "stage"], 2)


# --- audits -----------------------------------------------------------------------------------------------------


def _observations(spark, sf):
    base = views.utterances(spark, sf).groupBy("file_id").agg(F.max("end_sample").alias("n"), F.count(F.lit(1)).alias("k"))
    file = F.col("file_id")
    layouts = F.when(file % 20 == 7, F.array(F.lit("flat"))).otherwise(F.array(F.lit("flat"), F.lit("nested")))
    rows = base.select("file_id", "n", "k", F.explode(layouts).alias("layout"))
    odd = (F.col("layout") == "nested") & (file % 8 == 3)
    return rows.select(
        "file_id",
        "layout",
        F.sha2(F.concat(file.cast("string"), F.when(odd, F.lit("x")).otherwise(F.lit(""))), 256).alias("file_sha"),
        F.sha2(file.cast("string"), 256).alias("pcm_sha"),
        F.col("n").alias("sample_count"),
        F.col("n").alias("master_samples"),
        (F.col("n") + file % 3 - 1).alias("decoded_samples"),
        F.col("k").alias("interval_count"),
    )


@query
def layout_pairs(spark, sf):
    flat = views.utterances(spark, sf)
    nested = flat.withColumn("end_sample", F.col("end_sample") + F.when(F.col("file_id") % 9 == 4, 1).otherwise(0))
    return audit.layout_pairs(_observations(spark, sf), flat, nested)


@query
def media_delta(spark, sf):
    return audit.media_delta(_observations(spark, sf))


def _with_header(df):
    return df.select("relative_path", "sha256", ft.has_vtt_header(F.col("text"), strict=False).alias("has_header"))


@query
def repeatability(spark, sf):
    return audit.repeatability(_with_header(views.run_outputs(spark, sf, "b")), _with_header(views.run_outputs(spark, sf, "a")))


@query
def compare_runs(spark, sf):
    """Folders of two runs, and the files that differ."""
    found = evaluate.compare_runs(_with_header(views.run_outputs(spark, sf, "b")), _with_header(views.run_outputs(spark, sf, "a")))
    folders = found.folders.select(F.lit("folder").alias("part"), F.col("folder").alias("path"), "files_current", "files_baseline", F.when(F.col("same"), "same").otherwise("differs").alias("verdict"))
    files = found.differences.select(F.lit("file").alias("part"), F.col("relative_path").alias("path"), F.col("in_current").cast("bigint").alias("files_current"), F.col("in_baseline").cast("bigint").alias("files_baseline"), "verdict")
    return folders.unionByName(files)


@query
def compare_equal_runs(spark, sf):
    """A run and its repetition: every folder agrees, so that no file is looked at."""
    run = _with_header(views.run_outputs(spark, sf, "a"))
    found = evaluate.compare_runs(run, run)
    differing = found.differences.select(F.col("relative_path").alias("folder"), F.lit(1).alias("files_current"), F.lit(1).alias("files_baseline"), F.lit(False).alias("same"))
    return found.folders.unionByName(differing)


@query
def provenance(spark, sf):
    files = views.run_outputs(spark, sf, "b").select(F.upper("relative_path").alias("path"), "sha256")
    entries = views.run_outputs(spark, sf, "a").filter("doc_id % 11 <> 0").select("doc_id", F.col("relative_path").alias("path"), "sha256")
    doubled = entries.unionByName(entries.filter("doc_id % 12 = 0")).drop("doc_id")
    return audit.provenance(files, doubled)


def _evidence(spark, sf):
    work = views.run_outputs(spark, sf, "a").select("doc_id", "relative_path", F.concat(F.lit("/out/"), "relative_path").alias("output_path"))
    found = views.run_outputs(spark, sf, "b").select(F.concat(F.lit("/OUT/"), "relative_path").alias("path"), "text", F.length("text").alias("length"), "sha256")
    sentinels = views.run_outputs(spark, sf, "a").filter("doc_id % 2 = 0").select(F.concat(F.lit("/out/"), "relative_path").alias("path"), F.col("sha256").alias("sentinel_sha"))
    return work, audit.output_evidence(work, found, sentinels)


@query
def output_evidence(spark, sf):
    return _evidence(spark, sf)[1]


@query
def snapshot_sync(spark, sf):
    columns = ["state", "stage"]
    events = views.job_events(spark, sf)
    key = F.concat(F.when(F.col("seq") % 2 == 0, F.lit("Job-")).otherwise(F.lit("JOB-")), F.col("job_id").cast("string"))

    def snapshot(rows):
        latest = rows.groupBy("job_id").agg(F.max_by(F.struct("seq", *columns), "seq").alias("v"))
        return latest.select("job_id", "v.*").select(key.alias("key"), *columns, F.col("job_id").alias("position"))

    return audit.snapshot_changes(snapshot(events.filter("seq % 100 < 60 AND job_id % 9 <> 0")), snapshot(events.filter("job_id % 10 <> 0 AND job_id % 7 < 6")), "key", columns)


def _runs(spark, sf):
    """Documents as jobs of runs, one run per source, the scenarios in turn."""
    names = F.array(*map(F.lit, audit.SCENARIOS))
    docs = views.table(spark, sf, "documents").select("doc_id", "source")
    number = F.substring("source", 4, 10).cast("int")
    scenario = F.element_at(names, number % len(audit.SCENARIOS) + 1)
    work, evidence = _evidence(spark, sf)
    state = F.when(F.col("doc_id") % 6 == 1, "Failed").when(F.col("doc_id") % 15 == 2, "Cancelled").otherwise("Complete")
    detail = F.when(F.col("doc_id") % 4 == 0, F.lit(listing.SKIPPED)).otherwise(F.lit("ok"))
    rows = work.select("doc_id", "relative_path").join(evidence, "relative_path").join(docs, "doc_id")
    rows = rows.select(
        F.col("source").alias("run_id"), scenario.alias("scenario"), "output_path", "exists", "has_header", "header_only",
        "preseeded", "preserved", state.alias("state"), detail.alias("detail"), (F.col("doc_id") % 2).alias("cue_count"),
    )
    runs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("source").alias("run_id"),
        scenario.alias("scenario"),
        (F.col("n") + F.when(number % 7 == 6, 1).otherwise(0)).alias("expected_jobs"),
        F.when(number % 5 == 0, "Cancelled").otherwise("Complete").alias("final_stage"),
        (number % 5 == 0).alias("was_cancelled"),
        (number % 3 != 0).alias("saw_preflight"),
        (number % 2 == 0).alias("saw_model_load"),
        (number % 4 != 0).alias("saw_writing"),
        F.when(number == 13, F.lit("disk")).alias("fatal_error"),
        F.when(number == 12, 2).otherwise(0).alias("temporary_files"),
    )
    return runs, rows


@query
def job_audit(spark, sf):
    return audit.audit_jobs(_runs(spark, sf)[1])


@query
def run_audit(spark, sf):
    rows = evaluate.audit_run(*_runs(spark, sf))
    return rows.withColumn("run_violations", F.array_join("run_violations", "; "))


# --- quality rules ----------------------------------------------------------------------------------------------


@query
def manifest_header_rules(spark, sf):
    header = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("manifest_id"),
        (F.col("o_orderkey") % 5).alias("schema_version"),
        F.when(F.col("o_orderkey") % 6 == 0, F.lit(" ")).otherwise(F.lit("1.0")).alias("generator_version"),
        F.when(F.col("o_orderkey") % 7 == 0, 8_000).otherwise(16_000).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.lit(16).alias("bits_per_sample"),
        (F.col("o_orderkey") % 11 - 1).alias("tolerance_ms"),
        (F.col("o_orderkey") % 13).alias("fixture_count"),
    )
    return quality.header_rules(header)


@query
def fixture_rules(spark, sf):
    return quality.fixture_rules(views.fixtures(spark, sf), views.manifest_utterances(spark, sf))


@query
def text_rules(spark, sf):
    return quality.text_rules(views.manifest_utterances(spark, sf))


@query
def duplicate_paths(spark, sf):
    rows = views.fixtures(spark, sf).select(F.regexp_replace("flat_path", "[0-9]([.]mp4)$", "$1").alias("path"))
    return quality.duplicate_values(rows, "path", "duplicate path")


@query
def ground_truth_rules(spark, sf):
    return quality.ground_truth_rules(views.fixtures(spark, sf), views.manifest_utterances(spark, sf))


@query
def coverage_rules(spark, sf):
    return quality.coverage_rules(views.fixtures(spark, sf), 10)


# --- generation -------------------------------------------------------------------------------------------------


@query
def slack_allocation(spark, sf):
    """Extra silence spread over the gaps of every conversation."""
    rows = views.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("file_id", (F.col("n") * 20_000).cast("bigint").alias("slack"), F.array_repeat(F.lit(36_000).cast("bigint"), F.col("n").cast("int")).alias("capacities"))
    return synth.allocate_slack(rows, seed=7).select("file_id", "slack", F.aggregate("extra", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.forall("extra", lambda x: x.between(0, 36_000)).alias("within_bounds"))


@query
def stratified_depths(spark, sf):
    """Folder depth of every document: how many each depth got, which must be at least four."""
    placed = synth.assign_strata(views.table(spark, sf, "documents").select("doc_id"), "doc_id", [1, 2, 3], 4, seed=11)
    each = placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.sum("n").alias("placed"), F.count(F.lit(1)).alias("strata"), F.min("stratum").alias("lowest"), (F.min("n") >= 4).alias("enough")
    )


@query
def synthetic_corpus(spark, sf):
    """One synthetic recording per customer, with the rules it must keep."""
    ids = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"))
    rows = synth.corpus(ids, seed=3)
    low = F.when(F.col("band") == "short", 4).when(F.col("band") == "medium", 7).otherwise(10)
    length = lambda u: u["end_sample"] - u["start_sample"]
    covered = F.aggregate("utterances", F.lit(0).cast("bigint"), lambda a, u: a + length(u) + u["gap_before"])
    inner = F.slice("utterances", F.lit(2), F.size("utterances"))
    return rows.select(
        "file_id",
        "band",
        F.size("utterances").between(low, low + 1).alias("count_fits"),
        F.forall("utterances", lambda u: length(u).between(*quality.UTTERANCE_SAMPLES)).alias("lengths_fit"),
        F.forall(inner, lambda u: u["gap_before"].between(*quality.GAP_SAMPLES)).alias("gaps_fit"),
        (F.col("trailing_silence").between(*quality.EDGE_SAMPLES) & F.col("utterances")[0]["gap_before"].between(*quality.EDGE_SAMPLES)).alias("edges_fit"),
        (covered + F.col("trailing_silence") == F.col("total_samples")).alias("filled"),
    )


@query
def filled_durations(spark, sf):
    """A unit of speech repeated with gaps until each part's target length is full."""
    rows = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("file_id"),
        (F.col("p_size") * 1_000 + 500).cast("bigint").alias("unit"),
        F.lit(3_000).cast("bigint").alias("gap"),
        F.floor(F.col("p_retailprice") * 40).cast("bigint").alias("target"),
    )
    return synth.fill_duration(rows)


@query
def manifest_flat_map(spark, sf):
    """Utterances nested per recording and unnested again with their position."""
    nested = views.utterances(spark, sf).groupBy("file_id", tc.int_div(F.col("idx"), 3).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "start_sample", "end_sample"))).alias("u")
    )
    flat = nested.select("file_id", "part", F.posexplode("u").alias("at", "u"))
    flat = flat.withColumn("position", (F.col("part") * 3 + F.col("at")).cast("bigint"))
    return flat.select("file_id", "position", "u.start_sample", "u.end_sample")


@query
def worst_recording(spark, sf):
    rows = evaluate.evaluate_transcripts(views.utterances(spark, sf), views.detected(spark, sf))
    return rows.orderBy(F.desc("word_edit_percent"), "file_id").limit(1).select("file_id", "word_edits", "word_edit_percent")


# --- streams ----------------------------------------------------------------------------------------------------


@query
def stream_detect(spark, sf):
    """The adaptive detector fed frame by frame; its result is that of the batch detector."""
    rows = views.frames(spark, sf)
    ends = rows.groupBy("file_id").agg(F.max("frame_idx").alias("_last"))
    rows = rows.join(ends, "file_id").select("file_id", "start_sample", "end_sample", "dbfs", (F.col("frame_idx") == F.col("_last")).alias("is_last"))
    stream = runs.land(rows, "frames", ["file_id", "start_sample"])
    found = runs.drain(stateful.stream_detect(stream, views.ADAPTIVE), "detected")
    return found.filter("error IS NULL").drop("error")


@query
def stream_transcripts(spark, sf):
    rows = views.responses(spark, sf)
    ends = rows.groupBy("session_id").agg(F.max("seq").alias("_last"))
    rows = rows.join(ends, "session_id").select("session_id", "seq", "text", (F.col("seq") == F.col("_last")).alias("is_last"))
    parts = runs.drain(stateful.stream_transcripts(runs.land(rows, "responses", ["session_id", "seq"])), "transcripts")
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    return parts.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("transcript"))


def _positions(spark, sf, key):
    rows, block = blocked_by(views.job_events(spark, sf), [key], F.floor(F.col("seq") / 65_536))
    return row_index(rows, [key], block, ["seq"], "position")


@query
def stream_throttle(spark, sf):
    rows = _positions(spark, sf, "batch_id").select(
        "batch_id", "position", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("seq") % 11 == 0).alias("forced")
    )
    return runs.drain(stateful.stream_throttle(runs.land(rows, "events", ["batch_id", "position"]), 600_000), "published")


@query
def stream_transitions(spark, sf):
    rows = _positions(spark, sf, "job_id").select("job_id", "position", "seq", "state")
    verdicts = runs.drain(stateful.stream_transitions(runs.land(rows, "states", ["job_id", "position"])), "verdicts")
    return verdicts.filter("verdict <> 'ok'")


@query
def stream_stage_reports(spark, sf):
    rows = _positions(spark, sf, "job_id").select("job_id", "position", "seq", "stage", "forced")
    return runs.drain(stateful.stream_stage_reports(runs.land(rows, "reports", ["job_id", "position"])), "in-stage")


@query
def custom_detector(spark, sf):
    """A caller's own detector: every maximal run of loud frames."""

    def step(block, state, last):
        found, begin, upto = [], *(state or [None, None])
        for start, end, loud in zip(block["start_sample"], block["end_sample"], block["above"]):
            if loud:
                begin, upto = (start if begin is None else begin), end
            elif begin is not None:
                found.append((begin, upto))
                begin = None
        if last and begin is not None:
            found.append((begin, upto))
        return found, [begin, upto]

    return speech.detect_with(_marked(spark, sf), step, ["start_sample", "end_sample", "above"])


@query
def stream_snapshots(spark, sf):
    return runs.batch_snapshots(views.as_job_events(runs.table_stream(spark, sf, "events")), "snapshots")


@query
def stream_latest(spark, sf):
    events = views.as_job_events(runs.table_stream(spark, sf, "events")).withColumn("generation", F.col("seq") % 3)
    return runs.latest_by_key(events, ["job_id"], ["state", "stage"], "seq", "latest", generation=2)


@query
def stream_incremental(spark, sf):
    stream = runs.land(views.work(spark, sf), "work")
    return runs.incremental(stream, views.outputs(spark, sf), "skip", "pending")
