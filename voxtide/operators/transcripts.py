"""Transcript comparison and the assembly of recogniser responses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from voxtide.functions.scalars import safe_percent
from voxtide.functions.text import TEXTS, is_blank, normalize_text
from voxtide.functions.timecode import samples_to_ms
from voxtide.operators.edits import BLOCK_WORDS, tiled_edits, word_blocks
from voxtide.operators.intervals import BUCKET, overlap_pairs
from voxtide.operators.ordered import BLOCK, block_of, blocked_by, row_index, rows_to_here

def count_edits(a: list, b: list) -> int:
    """Levenshtein distance of two token lists, one bit per token of the shorter list.

    A whole column of the distance table is two integers (where it rises and where it falls), so that a pair costs
    its product of lengths divided by the machine word.
    """
    if len(a) > len(b):
        a, b = b, a
    start, top = 0, len(a)
    while start < top and a[start] == b[start]:
        start += 1
    cut = 0
    while cut < top - start and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[start : top - cut], b[start : len(b) - cut]
    if not a:
        return len(b)
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    rise, fall, get = full, 0, where.get
    for token in b:
        same = get(token, 0) | fall
        diagonal = (((same & rise) + rise) ^ rise) | same
        up = ((fall | (full & ~(diagonal | rise))) << 1) | 1
        rise = full & (((rise & diagonal) << 1) | ~(diagonal | up))
        fall = full & up & diagonal
    return len(b) + rise.bit_count() - fall.bit_count()


@F.arrow_udf(LongType())
def _word_edits(expected: pa.Array, actual: pa.Array) -> pa.Array:
    # A batch's words are many times as large as lists: only those of a few texts are at a time.
    pieces = ((expected.slice(at, TEXTS), actual.slice(at, TEXTS)) for at in range(0, len(expected), TEXTS))
    edits = [count_edits(a, b) for left, right in pieces for a, b in zip(left.to_pylist(), right.to_pylist())]
    return pa.array(edits, pa.int64())


def word_edits(expected: Column, actual: Column) -> Column:
    """Levenshtein distance over two token arrays, with unit costs.

    In Python because the built-in string distance takes time in the product of the lengths: spelling words as
    characters and using it was measured slower on short texts and takes minutes on a long one.
    """
    return _word_edits(expected, actual)


def transcript_diagnostics(
    expected: DataFrame, produced: DataFrame, normalized: bool = False, width: int = BUCKET, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per recording: words, word edits and cues or utterances that meet nothing on the other side.

    Both inputs have ``file_id, idx, start_sample, end_sample, text``. Recordings are those of ``expected``. Edits are
    counted in tiles of ``block_words``, so a transcript may have any length.
    """
    edits = tiled_edits(word_blocks(expected, normalized, block_words), word_blocks(produced, normalized, block_words))
    rows = expected.groupBy("file_id").agg(F.count(F.lit(1)).alias("_e_rows"))
    rows = rows.join(produced.groupBy("file_id").agg(F.count(F.lit(1)).alias("_a_rows")), "file_id", "left").join(edits, "file_id", "left")
    # One join finds the overlaps of both sides; what is not among them overlaps nothing.
    met = overlap_pairs(expected, produced, width).groupBy("file_id").agg(
        F.count_distinct("a_idx").alias("_met_e"), F.count_distinct("b_idx").alias("_met_a")
    )
    counted = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    alone = lambda side: counted(f"_{side}_rows") - counted(f"_met_{side}")
    return rows.join(met, "file_id", "left").select(
        "file_id",
        *[counted(name).alias(name) for name in ("expected_words", "actual_words", "word_edits")],
        safe_percent(counted("word_edits"), counted("expected_words")).alias("word_edit_percent"),
        alone("a").alias("produced_without_overlap"),
        alone("e").alias("expected_without_overlap"),
    )


def transcript_rollup(diagnostics: DataFrame) -> DataFrame:
    """Corpus sums, percentage from the sums, and the worst recording (highest percentage, then lowest id)."""
    worst = F.struct("word_edit_percent", (-F.col("file_id")).alias("neg"), "file_id", "word_edits", "expected_words")
    sums = ("expected_words", "actual_words", "word_edits", "produced_without_overlap", "expected_without_overlap")
    total = diagnostics.agg(
        F.count(F.lit(1)).alias("recordings"), *[F.sum(c).alias(c) for c in sums], F.max(worst).alias("_w")
    )
    return total.select(
        "recordings",
        *sums,
        safe_percent(F.col("word_edits"), F.col("expected_words")).alias("word_edit_percent"),
        F.col("_w.file_id").alias("worst_file_id"),
        F.col("_w.word_edits").alias("worst_word_edits"),
        F.col("_w.word_edit_percent").alias("worst_percent"),
    )


def cue_agreement(utterances: DataFrame, cues: DataFrame, normalized: bool = False) -> DataFrame:
    """Disagreements between utterance i and cue i of a file: missing partner, timing or normalised text."""
    left = utterances.select(
        "file_id",
        "idx",
        samples_to_ms(F.col("start_sample")).alias("_s"),
        samples_to_ms(F.col("end_sample")).alias("_e"),
        F.col("text").alias("_t"),
        F.lit(True).alias("_u"),
    )
    right = cues.select(
        "file_id", (F.col("cue_no") - 1).alias("idx"), "start_ms", "end_ms", F.col("text").alias("_c"), F.lit(True).alias("_k")
    )
    rule = (
        F.when(F.col("_u").isNull(), F.lit("extra cue"))
        .when(F.col("_k").isNull(), F.lit("missing cue"))
        .when((F.col("_s") != F.col("start_ms")) | (F.col("_e") != F.col("end_ms")), F.lit("timing"))
        .when(normalize_text(F.col("_t"), normalized) != normalize_text(F.col("_c"), normalized), F.lit("text"))
    )
    return left.join(right, ["file_id", "idx"], "full").withColumn("rule", rule).filter("rule IS NOT NULL").select("file_id", "idx", "rule")


def emission_gaps(responses: DataFrame, block_size: int | None = None) -> DataFrame:
    """Responses whose sequence number is not their position in the session."""
    rows, block = blocked_by(responses, ["session_id"], block_of(F.col("seq"), block_size or BLOCK), force=bool(block_size))
    rows = row_index(rows, ["session_id"], block, ["seq"], "position")
    return rows.filter("position <> seq").select("session_id", "seq", "position")


def push_metrics(pushes: DataFrame) -> DataFrame:
    """Per session: number of pushes, whether any had to wait, longest and total milliseconds."""
    return pushes.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.bool_or("waited").alias("any_wait"),
        F.max("elapsed_ms").alias("max_ms"),
        F.sum("elapsed_ms").alias("total_ms"),
    )


def fold_text(current: str, text: str) -> str:
    """One emission: a snapshot that continues the text replaces it, a repeat or older snapshot changes nothing."""
    if not text or current.startswith(text):
        return current
    return text if text.startswith(current) else current + text


def accumulate_transcripts(responses: DataFrame, run_block: int = 4_096) -> DataFrame:
    """Transcript of every session from its ordered emissions ``session_id, seq, text``.

    The text only ever grows at its end, so it always begins with the first emission. An emission that neither begins
    with that one nor is a beginning of it can be no snapshot: it is appended whatever came before. Runs of such plain
    additions within a block of sequence numbers are joined before the shuffle's last step, so a session arrives as a
    few rows; those pass through one task in order, holding nothing but the transcript, which is one value of the
    result.
    """
    rows = responses.filter(~is_blank(F.col("text"))).select("session_id", "seq", "text")
    heads = rows.groupBy("session_id").agg(F.min_by("text", "seq").alias("_head"))
    rows = rows.join(heads, "session_id").withColumn("_b", block_of(F.col("seq"), run_block))
    snapshot = F.startswith("text", F.col("_head")) | F.startswith("_head", F.col("text"))
    # Position of the latest possible snapshot within the block: plain additions after it form one run.
    here = rows_to_here(["session_id"], "_b", ["seq"])
    marked = rows.withColumn("_snap", snapshot).withColumn("_run", F.max(F.when(F.col("_snap"), F.col("seq"))).over(here))
    runs = (
        marked.groupBy("session_id", "_b", "_run", "_snap")
        .agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_p"))
        .select("session_id", "seq", "_snap", F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))
    )
    ordered = runs.repartition("session_id").sortWithinPartitions("session_id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, parts = None, []
        for batch in batches:
            done = []
            for key, snap, text in zip(batch["session_id"], batch["_snap"], batch["text"]):
                if session is not None and key != session:
                    done.append((session, "".join(parts)))
                    parts = []
                session = key
                if snap:
                    parts = [fold_text("".join(parts), text)]
                else:
                    parts.append(text)
            if done:
                yield pd.DataFrame(done, columns=["session_id", "transcript"])
        if session is not None:
            yield pd.DataFrame([(session, "".join(parts))], columns=["session_id", "transcript"])

    kind = responses.schema["session_id"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"session_id {kind}, transcript string")
