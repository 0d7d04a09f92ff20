"""Registered queries of the numbered operators: each maps the given tables to an operator's columns and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import alignment, archives, byte_bpe, line_dedup, loops, quality_rules, raking, simhash, surrogates, tool_links, vector_dedup, word_bpe, wrappers

BPE_RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Topics by the terms that mark them, and how strongly the mix keeps the margins' own proportions.
TOPICS = {"licence": ("License", "CC BY-NC"), "contact": ("@", "+1 ("), "table": (" | ",)}
# Of the test tables only; a user of the operator has a secret of their own.
SURROGATE_KEY = "test tables"
CALL_SCHEMAS = {
    tool: {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0, "maximum": last}},
        "additionalProperties": False,
    }
    for tool, last in (("answer", 1_000_000), ("configure", 0))
}
MIX = {"folder": 0.8, "language": 0.8, "topic": 0.8}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts, their source as the folder."""
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("folder"), "text")
    return quality_rules.judge_transcripts(transcripts).select(
        F.col("file_id").alias("doc_id"),
        F.col("words").alias("n_words"),
        "word_chars",
        F.col("symbols").alias("n_symbols"),
        F.col("repeated_lines").alias("n_dup_lines"),
        F.col("repeated_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
        F.round("folder_rate", 6).alias("host_rate"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    encoded = byte_bpe.encode_transcripts(transcripts, path, public_tokenizers.PATTERN).select(
        "file_id", "token_ids", F.size(F.array_distinct("char_starts")).alias("starts")
    )
    return byte_bpe.decode_tokens(encoded, path).select(
        F.col("file_id").alias("doc_id"),
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
        # Tokens that begin in a character in which an earlier one began.
        (F.size("token_ids") - F.col("starts")).cast("bigint").alias("n_split_tokens"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.extract_pages(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "host", "fitted")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def near_vectors_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors beside altered ones, as the given ones are far from each other: every other vector again three times
    as long, without its first component, and without its first two."""
    given = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    every = given
    for cut in (1, 2):
        altered = F.expr(f"transform(embedding, (x, i) -> IF(i < {cut}, 0.0D, x * 3.0D))")
        every = every.union(given.filter("vec_id % 2 = 0").select((F.col("vec_id") + F.lit(cut * 1_000_000_000).cast("bigint")).alias("vec_id"), altered.alias("embedding")))
    return vector_dedup.near_vectors(every)


def op5_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions: what a user or the system says is a call, needing the one before, and the
    assistant's turn is the result of the call one turn earlier.

    Logs are never in order: some calls are logged early or late, so before or together with what they need; some need
    each other, or calls that the session lacks; some have arguments that are no JSON or break the schema, or an unknown tool.
    """
    turns = _table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("turn-"), F.col("turn").cast("string")))
    size = F.length(F.coalesce("text", F.lit("")))
    early, late = (F.col("conv_id") + F.col("turn")) % 4 == 1, (F.col("conv_id") + F.col("turn")) % 6 == 2
    needs = F.array(
        F.when(F.col("turn") >= 2, F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string"))),
        F.when((F.col("conv_id") % 5 == 3) & (F.col("turn") % 4 < 2), F.concat(F.lit("turn-"), (F.col("turn") + 2).cast("string"))),
        F.when(size % 7 == 0, F.concat(F.lit("lost-"), size.cast("string"))),
    )
    asked = turns.filter("role <> 'assistant'").select(
        F.col("conv_id").alias("session_id"),
        F.when(early, F.greatest(F.col("turn") - 5, F.lit(0))).when(late, F.col("turn") + 4).otherwise(F.col("turn")).cast("bigint").alias("seq"),
        F.col("id").alias("call_id"),
        F.when(F.col("role") == "system", "configure").when(size % 13 == 0, "unlisted").otherwise("answer").alias("tool"),
        F.when(size % 11 == 0, '{"text":').when(size % 17 == 0, '{"turn":-1}').otherwise(F.to_json(F.struct("turn", "text"))).alias("arguments"),
        needs.alias("after"),
    )
    answered = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"),
    )
    linked = tool_links.link_calls(asked, answered, CALL_SCHEMAS)
    names = ("call_id", "seq", "result_seq", "status", "rank", "level", "cyclic", "dangling", "valid", "message")
    return linked.select(F.col("session_id").alias("conv_id"), *names, F.array_join("errors", "; ").alias("errors"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    replaced = surrogates.replace_entities(transcripts, SURROGATE_KEY)
    counts = [F.col("entities")[kind].cast("bigint").alias(f"n_{kind}") for kind in surrogates.PATTERNS]
    return replaced.select(F.col("file_id").alias("doc_id"), "text", *counts)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    found = simhash.near_transcripts(transcripts)
    return found.select(
        F.col("file_id").alias("doc_id"), simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def as_mixable(documents: DataFrame) -> DataFrame:
    """The margins and token weights of documents: words, and a topic by terms."""
    return documents.withColumnsRenamed({"doc_id": "file_id", "source": "folder", "lang": "language"}).withColumns(
        {
            "topic": raking.topic_of(F.col("text"), TOPICS),
            "tokens": F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("bigint"),
        }
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.mix_transcripts(as_mixable(_table(spark, sf_dir, "documents")).drop("text"), MIX)
    return mixed.select(
        F.col("file_id").alias("doc_id"),
        F.col("folder").alias("source"),
        F.col("language").alias("lang"),
        "topic",
        F.col("tokens").alias("n_tokens"),
        F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        F.col("sampled").alias("kept"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    kept = line_dedup.drop_shared_lines(documents)
    return kept.select(
        F.col("file_id").alias("doc_id"),
        F.col("lines").alias("n_lines"),
        F.col("dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archives.archive_folder(spark)
    records = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    archives.write_archives(records, folder)
    return archives.read_archives(spark, folder).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    encoded = word_bpe.encode_transcripts(transcripts, path).drop("text")
    return word_bpe.decode_tokens(encoded, path).select(
        F.col("file_id").alias("doc_id"),
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("merged_exactly").alias("n_exact_words"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts, in a tenth of which a recogniser got stuck: from some word on the same words recur."""
    mark = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = _table(spark, sf_dir, "documents").select("doc_id", "text", F.when(mark % 10 == 0, words).alias("words"), F.expr("crc32(cast(doc_id AS string)) div 10").alias("g"))
    stuck = (
        cut.withColumn("n", F.size("words"))
        .withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    )
    looped = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p AS int))), 1, n - a))")
    text = F.when(F.col("p").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text"))
    found = loops.find_loops(stuck.select(F.col("doc_id").alias("file_id"), text.alias("text")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        F.col("file_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    aligned = alignment.align_transcripts(transcripts, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))
    digest = F.when(F.col("a_tokens") > 0, F.sha2("grouping", 256)).otherwise("")
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("text", "grouping"))
    return scored.select(
        F.col("file_id").alias("doc_id"),
        F.col("a_tokens").alias("n_a"),
        F.col("b_tokens").alias("n_b"),
        F.col("groups").alias("n_groups"),
        F.col("links").alias("n_links"),
        F.col("best_links").alias("n_best"),
        "count_sum",
        "groups_sha256",
        F.col("overlaps").alias("n_overlaps"),
    )


_ALL = (
    op1_quality_rules,
    op2_byte_bpe,
    op3_html_extraction,
    op4_vector_dedup,
    op5_tool_links,
    op6_surrogates,
    op7_simhash,
    op8_source_mixing,
    op9_line_dedup,
    op10_warc,
    op11_word_bpe,
    op12_periodic_runs,
    op13_token_alignment,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_ALL, near_vectors_altered)}
