"""Operator inputs derived from the given tables. Every view covers its whole source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.functions.scalars import NEG_INF
from voxtide.functions.text import sha256_hex
from voxtide.functions.timecode import int_div
from voxtide.operators.cues import timeline
from voxtide.operators.ordered import blocked_by, row_index, settle, spread, time_block
from voxtide.operators.speech import NO_CAP
from voxtide.options import DetectorOptions, SegmenterOptions

FRAME = 320
# Fixed thresholds at -20 and -26 dBFS, short timings that suit the sparse event series.
TIMING = SegmenterOptions(2, 3, 320, 320, 640, 320, NO_CAP, 1_600)
FIXED = DetectorOptions(FRAME, -30.0, -90.0, -20.0, 0.0, 10.0, 4.0, -90.0, -90.0, TIMING)
CAPPED = DetectorOptions(
    FRAME, -30.0, -90.0, -20.0, 0.0, 10.0, 4.0, -90.0, -90.0, SegmenterOptions(2, 3, 320, 320, 640, 320, 3_200, 1_600)
)
BREAKING = DetectorOptions(
    FRAME, -30.0, -90.0, -20.0, 0.0, 10.0, 4.0, -90.0, -90.0, SegmenterOptions(2, 3, 3_200, 0, 320, 320, 1_600, 1_600)
)
ADAPTIVE = DetectorOptions(
    FRAME, -40.0, -90.0, -20.0, 0.05, 12.0, 7.0, -45.0, -50.0, SegmenterOptions(2, 3, 320, 320, 640, 320, 3_200, 1_600)
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work on whole texts."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def indexed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events numbered per user in time order."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("file_id"), "ts", "event_id", "event_type", "value")
    rows, block = blocked_by(events, ["file_id"], time_block(F.col("ts")))
    return settle(row_index(rows, ["file_id"], block, ["ts", "event_id"], "frame_idx").drop("_b"), block)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("value") > 0, F.round(F.lit(20.0) * F.log10(F.col("value") / 500), 6)).otherwise(F.lit(NEG_INF))
    return indexed_events(spark, sf).select(
        "file_id",
        "frame_idx",
        (F.col("frame_idx") * FRAME).alias("start_sample"),
        ((F.col("frame_idx") + 1) * FRAME).alias("end_sample"),
        level.alias("dbfs"),
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_events(spark, sf).select(
        "file_id", F.col("frame_idx").alias("idx"), F.round((F.col("value") - 35) * 60).cast("int").alias("s")
    )


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Turns laid out one after another with half a second between them."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").alias("idx"),
        F.when(F.col("turn") == 0, 0).otherwise(8_000).cast("bigint").alias("gap_before"),
        (F.length("text") * 800).cast("bigint").alias("length"),
        "text",
    )
    return timeline(turns)


def cues(spark: SparkSession, sf: str) -> DataFrame:
    return utterances(spark, sf).withColumnRenamed("idx", "cue_idx")


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances moved by up to a fifth of a second, some lost, some cut in two."""
    file, turn = F.col("file_id"), F.col("idx")
    shift = ((file * 7 + turn * 13) % 5 - 2) * 1_600
    rows = utterances(spark, sf).filter((file + turn) % 11 != 0)
    start, end = F.greatest(F.col("start_sample") + shift, F.lit(0)), F.col("end_sample") + shift
    middle = start + int_div(end - start, 2)
    cut = (file + turn * 2) % 7 == 0
    half = lambda i, a, b: F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"))
    pieces = F.when(cut, F.array(half(0, start, middle), half(1, middle, end))).otherwise(F.array(half(0, start, end)))
    rows = rows.select("file_id", "idx", "text", F.explode(pieces).alias("p"), cut.alias("cut"))
    words = F.split("text", " ")
    keep = int_div(F.size(words), 2)
    head, tail = F.slice(words, F.lit(1), keep), F.slice(words, keep + 1, F.size(words))
    text = F.when(~F.col("cut"), F.col("text")).otherwise(
        F.array_join(F.when(F.col("p.i") == 0, head).otherwise(tail), " ")
    )
    return rows.select(
        "file_id",
        (F.col("idx") * 2 + F.col("p.i")).alias("idx"),
        F.col("p.a").alias("start_sample"),
        F.col("p.b").alias("end_sample"),
        text.alias("text"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as emissions with odd sequence numbers for snapshots, repeats and blanks."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    first = turns.filter("turn = 0").select("session_id", F.col("text").alias("_h"))
    rows = turns.join(first, "session_id", "left")
    extra = (
        F.when(F.col("turn") == 1, F.concat("_h", "text", F.when(F.col("session_id") % 3 == 0, "!").otherwise("")))
        .when(F.col("turn") % 2 == 0, F.col("_h"))
        .otherwise(F.lit("  "))
    )
    pair = F.array(
        F.struct((F.col("turn") * 2).alias("seq"), F.col("text").alias("text")),
        F.struct((F.col("turn") * 2 + 1).alias("seq"), extra.alias("text")),
    )
    return rows.select("session_id", F.explode(pair).alias("e")).select("session_id", "e.seq", "e.text")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files below /in, in three spellings of the extension and some of another kind."""
    extension = F.element_at(F.array(*map(F.lit, (".MP4", ".mp4", ".Mp4", ".wav"))), (F.col("doc_id") % 4 + 1).cast("int"))
    relative = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), extension)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/"), relative).alias("path"),
        relative.alias("relative_path"),
        (F.col("doc_id") % 19 == 0).alias("is_dir"),
        F.col("n_chars").alias("length"),
    )


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return listing(spark, sf).filter("NOT is_dir AND path RLIKE '(?i)[.]mp4$'")


def work(spark: SparkSession, sf: str) -> DataFrame:
    from voxtide.operators.listing import plan_work

    return plan_work(recordings(spark, sf).select(F.col("path").alias("input_path"), "relative_path"), "/out")


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What lies below /out: a caption file for every labelled document, upper-case names now and then."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    path = F.concat(F.lit("/out/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".vtt"))
    return rows.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.upper(path)).otherwise(path).alias("path"),
        (F.col("doc_id") % 23 == 0).alias("is_dir"),
        F.col("n_chars").alias("length"),
    )


# How event types stand for stages and states.
STAGES = {
    "view": "ExtractingAudio",
    "click": "DetectingSpeech",
    "purchase": "Transcribing",
    "signup": "WritingVtt",
    "error": "Failed",
}
STATES = {"view": "Pending", "click": "Transcribing", "purchase": "Complete", "signup": "Transcribing", "error": "Failed"}


def _mapped(values: dict[str, str]):
    result = F.lit(None).cast("string")
    for k, v in values.items():
        result = F.when(F.col("event_type") == k, v).otherwise(result)
    return result


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_job_events(table(spark, sf, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as job events with reports that are missing, infinite or not a number."""
    odd = F.col("event_id") % 50
    progress = (
        F.when(odd == 0, F.lit(float("nan")))
        .when(odd == 1, F.lit(float("inf")))
        .when(odd == 2, F.lit(None).cast("double"))
        .otherwise(F.col("value") / 400)
    )
    return events.select(
        (F.col("user_id") % 8).alias("batch_id"),
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        _mapped(STATES).alias("state"),
        _mapped(STAGES).alias("stage"),
        progress.alias("progress"),
        (F.col("event_id") % 3 == 0).alias("forced"),
        (F.col("event_id") % 7).alias("cue_count"),
        F.col("value"),
    )


def run_outputs(spark: SparkSession, sf: str, run: str) -> DataFrame:
    """Documents as the caption outputs of a run; run b lost some, changed some, and has headers on most."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    if run == "b":
        docs = docs.filter("doc_id % 17 <> 0").withColumn(
            "text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
        )
    header = F.when(F.col("doc_id") % 29 == 0, F.lit("")).otherwise(F.lit("WEBVTT\n\n"))
    content = F.when(F.col("doc_id") % 31 == 0, header).otherwise(F.concat(header, "text"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".vtt"))
    return docs.select("doc_id", path.alias("relative_path"), content.alias("text")).withColumn(
        "sha256", sha256_hex(F.encode("text", "UTF-8"))
    )


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as manifest fixtures, some with faults."""
    ends = utterances(spark, sf).groupBy("file_id").agg(F.max("end_sample").alias("end"))
    file = F.col("file_id")
    name = F.concat(F.lit("rec-"), F.format_string("%08d", file))
    digest = F.sha2(file.cast("string"), 256)
    depth = (file % 4 + 1).cast("int")
    folder = F.concat_ws("/", F.slice(F.array(F.lit("north wing"), F.lit("salle é"), F.lit("c"), F.lit("d")), F.lit(1), depth))
    total = F.col("end") + (file % 5) * 10_000
    return ends.select(
        "file_id",
        total.alias("total_samples"),
        ((file % 5) * 10_000 + F.when(file % 9 == 0, 1).otherwise(0)).alias("trailing_silence"),
        F.concat(F.lit("flat/"), name, F.lit(".mp4")).alias("flat_path"),
        F.concat(F.when(file % 10 == 3, F.lit("../")).otherwise(F.lit("")), F.lit("nested/"), folder, F.lit("/"), name, F.lit(".mp4")).alias("nested_path"),
        F.when(file % 8 == 1, F.lit(" ")).otherwise(F.concat(F.lit("vtt/"), name, F.lit(".vtt"))).alias("vtt_path"),
        F.when(file % 6 == 2, F.substring(digest, 1, 60)).otherwise(F.upper(digest)).alias("file_sha"),
        digest.alias("pcm_sha"),
        F.element_at(F.array(*map(F.lit, ("short", "medium", "long", "other"))), (F.when(file % 25 == 0, 4).otherwise(file % 3 + 1)).cast("int")).alias("band"),
        (total / 16_000.0).alias("target_seconds"),
    )


def manifest_utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances with the manifest's derived columns, some of them wrong."""
    from voxtide.functions.text import normalize_text

    file, turn = F.col("file_id"), F.col("idx")
    rows = utterances(spark, sf)
    wrong = F.when((file + turn) % 12 == 0, F.lit(" x")).otherwise(F.lit(""))
    return rows.select(
        "file_id",
        "idx",
        (F.col("start_sample") - F.when((file + turn) % 14 == 5, 9_000).otherwise(0)).alias("start_sample"),
        "end_sample",
        F.when(turn == 0, 0).otherwise(8_000).cast("bigint").alias("gap_before"),
        (F.col("start_sample") / 16_000.0).alias("start_seconds"),
        (F.col("end_sample") / 16_000.0 + F.when(turn == 3, 0.001).otherwise(0.0)).alias("end_seconds"),
        "text",
        F.concat(normalize_text(F.col("text")), wrong).alias("normalized_text"),
    )


def _little_endian(n: Column, size: int) -> Column:
    """A number as bytes, lowest first."""
    byte = lambda i: F.unhex(F.lpad(F.hex(F.call_function("shiftright", n.cast("bigint"), F.lit(8 * i)).bitwiseAND(255)), 2, "0"))
    return F.concat(*[byte(i) for i in range(size)])


def wave_bytes(pcm: Column, tag: Column | None = None, rate: Column | None = None) -> Column:
    """A WAVE file around PCM data of even length."""
    rate = F.lit(16_000) if rate is None else rate
    size = F.octet_length(pcm)
    ascii_bytes = lambda s: F.lit(s.encode())
    header = F.concat(
        ascii_bytes("RIFF"), _little_endian(size + 36, 4), ascii_bytes("WAVEfmt "), _little_endian(F.lit(16), 4),
        _little_endian(F.lit(1) if tag is None else tag, 2), _little_endian(F.lit(1), 2), _little_endian(rate, 4),
        _little_endian(rate * 2, 4), _little_endian(F.lit(2), 2), _little_endian(F.lit(16), 2),
    )
    return F.concat(header, ascii_bytes("data"), _little_endian(size, 4), pcm)


def wave_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as WAVE files: their bytes are the samples. Some have a wrong format or are cut short."""
    raw = F.encode("text", "UTF-8")
    even = F.substring(raw, F.lit(1), F.octet_length(raw) - F.octet_length(raw) % 2)
    doc = F.col("doc_id")
    content = wave_bytes(F.col("_pcm"), F.when(doc % 7 == 3, 3).otherwise(1), F.when(doc % 11 == 5, 8_000).otherwise(16_000))
    whole = documents(spark, sf).withColumn("_pcm", even).select("doc_id", content.alias("content"))
    cut = F.substring(F.col("content"), F.lit(1), F.octet_length("content") - 1)
    return whole.select("doc_id", F.concat(doc.cast("string"), F.lit(".wav")).alias("path"), F.when(doc % 13 == 1, cut).otherwise(F.col("content")).alias("content"))


def landed(files: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Files ``path, content`` below a new shared folder: their paths there, and the folder."""
    from voxtide.sources.keyed import write_keyed
    from voxtide.streaming.runs import new_folder

    folder = new_folder(files.sparkSession, name)
    written = write_keyed(files.select(F.col("path").alias("output_path"), F.lit(0).alias("part_no"), "content"), folder)
    return written.select(F.concat(F.lit(folder + "/"), "output_path").alias("path"), F.col("output_path").alias("relative_path")), folder


def tone_files(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as recordings: silence, a loud stretch whose length depends on the text, silence. One in seven is
    no WAVE file and one in eleven ends inside its data."""
    loud = F.length("text") * 320 + 8_000
    samples = F.concat(F.repeat(F.lit("0000"), F.lit(6_400)), F.repeat(F.lit("0040"), loud), F.repeat(F.lit("0000"), F.lit(12_800)))
    rows = table(spark, sf, "benchmark").select("item_id", wave_bytes(F.unhex(samples)).alias("_wave"))
    item = F.col("item_id")
    content = F.when(item % 7 == 3, F.lit(b"no sound at all")).when(item % 11 == 4, F.substring("_wave", 1, 20_000)).otherwise(F.col("_wave"))
    return rows.select("item_id", F.format_string("%d.wav", "item_id").alias("path"), content.alias("content"))
