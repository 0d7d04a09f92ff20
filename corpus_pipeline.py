"""Training corpus from documents: quality rules, line dedup, SimHash near-dedup, source mixing, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and calls one operator of ``voxtide.llm`` on all that its predecessor
kept. All but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars); further columns of
the input do not pass. A stage that only reads nothing gives nothing: an empty table runs through.

SQL has neither the seeded hash of the fingerprints nor the merges of BPE, so there is no ORACLE_SQL; tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtide.llm import byte_bpe, line_dedup, quality_rules, raking, simhash
from voxtide.llm.queries import BPE_RANKS, MIX, as_mixable
from voxtide.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _row_key() -> Column:
    """Names a row by id and text, so that rows that share an id, or have none, are judged by themselves."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from a source that does not fail as a whole."""
    rows = docs.select(*COLUMNS).withColumn("_key", _row_key())
    verdicts = quality_rules.judge_transcripts(rows.select(F.col("_key").alias("file_id"), F.col("source").alias("folder"), "text"))
    return rows.join(verdicts.filter("kept").select(F.col("file_id").alias("_key")), "_key", "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that later documents share; ``n_chars`` is that of the new text."""
    cut = line_dedup.drop_shared_lines(docs.select(*COLUMNS).withColumnRenamed("doc_id", "file_id"))
    cut = cut.withColumn("n_chars", F.when(F.col("dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.withColumnRenamed("file_id", "doc_id").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of its rows with one text, one.

    Rows are judged by id and text: those that share an id but are no copies of each other stay beside each other.
    Rows without an id name no group and stay.
    """
    rows = docs.select(*COLUMNS)
    known = rows.filter("doc_id IS NOT NULL").withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("h")))
    groups = simhash.near_transcripts(known.select(F.col("_row").alias("file_id"), "text"))
    first = groups.filter("file_id = component_id").groupBy(F.col("file_id").alias("_row")).agg(F.count(F.lit(1)).alias("_copies"))
    kept = known.join(first, "_row")
    # Only rows that are there more than once are ordered.
    order = Window.partitionBy("_row").orderBy("lang", "source", "n_chars")
    more = kept.filter("_copies > 1").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return kept.filter("_copies = 1").select(*COLUMNS).union(more.select(*COLUMNS)).union(rows.filter("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their weights."""
    mixed = raking.mix_transcripts(as_mixable(docs.select(*COLUMNS)), MIX).filter("sampled")
    return mixed.withColumnsRenamed({"file_id": "doc_id", "folder": "source", "language": "lang"}).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their characters, and whether decoding gives the text again."""
    path = public_tokenizers.path(BPE_RANKS)
    rows = docs.select(F.col("doc_id").alias("file_id"), "text", "lang", "source", "n_chars")
    coded = byte_bpe.encode_transcripts(rows, path, public_tokenizers.PATTERN)
    # Ids go on to the decoder with their text's digest, so that no task holds batches of both.
    coded = coded.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    coded = byte_bpe.decode_tokens(coded, path)
    same = F.sha2("content", 256) == F.col("digest")
    return coded.select(
        F.col("file_id").alias("doc_id"),
        "lang",
        "source",
        "n_chars",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        "token_ids",
        "char_starts",
        same.alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("source_mixing", mixing),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; every stage is a written table of the shared folder."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
