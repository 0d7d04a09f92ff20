"""Corpus manifests: nested JSON to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SILENCE = "struct<samples:bigint,seconds:double>"
_UTTERANCE = (
    "struct<authoredText:string,normalizedExpectedText:string,startSample:bigint,endSample:bigint,"
    "startSeconds:double,endSeconds:double>"
)
_FIXTURE = (
    "struct<fixtureId:string,fileName:string,flatPath:string,nestedRelativePath:string,sha256:string,"
    "masterPcmDataSha256:string,durationCoverageBand:string,requestedTargetDurationSeconds:double,"
    "targetDurationSeconds:double,decodedDurationSeconds:double,masterDurationSamples:bigint,masterDurationSeconds:double,"
    f"audioTrackCount:int,videoTrackCount:int,leadingSilence:{_SILENCE},interUtteranceSilences:array<{_SILENCE}>,"
    f"trailingSilence:{_SILENCE},utterances:array<{_UTTERANCE}>,expectedVttPath:string>"
)
SCHEMA = (
    "schemaVersion int, generatorVersion string, randomSeed decimal(20,0), generationTimestampUtc string, "
    "host struct<windowsBuild:string,architecture:string>, "
    "voice struct<requestedVoiceId:string,fallbackUsed:boolean,id:string,displayName:string,language:string,gender:string>, "
    "masterPcm struct<encoding:string,sampleRate:int,channels:int,bitsPerSample:int>, "
    "outputMedia struct<container:string,audioCodec:string,fileExtension:string,sampleRate:int,channels:int,bitrate:bigint>, "
    "normalization struct<unicodeNormalization:string,casing:string,punctuation:string,whitespace:string>, "
    f"vadTimingToleranceMilliseconds int, fixtures array<{_FIXTURE}>"
)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the fixed schema; each is one JSON document."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("manifest_id", F.col("_metadata.file_path"))


def headers(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "manifest_id",
        F.col("schemaVersion").alias("schema_version"),
        F.col("generatorVersion").alias("generator_version"),
        F.col("masterPcm.sampleRate").alias("sample_rate"),
        F.col("masterPcm.channels").alias("channels"),
        F.col("masterPcm.bitsPerSample").alias("bits_per_sample"),
        F.col("vadTimingToleranceMilliseconds").alias("tolerance_ms"),
        F.coalesce(F.size("fixtures"), F.lit(0)).alias("fixture_count"),
    )


def fixtures(manifests: DataFrame) -> DataFrame:
    return manifests.select("manifest_id", F.explode("fixtures").alias("f")).select(
        F.col("f.fixtureId").alias("file_id"),
        F.col("f.masterDurationSamples").alias("total_samples"),
        F.col("f.trailingSilence.samples").alias("trailing_silence"),
        F.col("f.flatPath").alias("flat_path"),
        F.col("f.nestedRelativePath").alias("nested_path"),
        F.col("f.expectedVttPath").alias("vtt_path"),
        F.col("f.sha256").alias("file_sha"),
        F.col("f.masterPcmDataSha256").alias("pcm_sha"),
        F.col("f.durationCoverageBand").alias("band"),
        F.col("f.requestedTargetDurationSeconds").alias("target_seconds"),
        "manifest_id",
    )


def utterances(manifests: DataFrame) -> DataFrame:
    """One row per utterance with the silence before it."""
    rows = manifests.select(F.explode("fixtures").alias("f")).select("f", F.posexplode("f.utterances").alias("idx", "u"))
    gap = F.when(F.col("idx") == 0, F.col("f.leadingSilence.samples")).otherwise(
        F.get("f.interUtteranceSilences", F.col("idx") - 1)["samples"]
    )
    return rows.select(
        F.col("f.fixtureId").alias("file_id"),
        F.col("idx").cast("bigint").alias("idx"),
        F.col("u.startSample").alias("start_sample"),
        F.col("u.endSample").alias("end_sample"),
        gap.alias("gap_before"),
        F.col("u.startSeconds").alias("start_seconds"),
        F.col("u.endSeconds").alias("end_seconds"),
        F.col("u.authoredText").alias("text"),
        F.col("u.normalizedExpectedText").alias("normalized_text"),
    )


def silences(manifests: DataFrame) -> DataFrame:
    rows = manifests.select(F.explode("fixtures").alias("f"))
    both = F.concat(F.array("f.leadingSilence"), F.coalesce("f.interUtteranceSilences", F.array()), F.array("f.trailingSilence"))
    return rows.select(F.col("f.fixtureId").alias("file_id"), F.posexplode(both).alias("position", "s")).select(
        "file_id", "position", "s.samples", "s.seconds"
    )
