"""Quality rules of transcripts, with a verdict on the folders (hosts) that publish them. Column functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.session import cut_lineage

# ASCII white space; everything else belongs to words.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Of a packed window: texts of over 16 million windows are sorted by their whole hashes instead.
PLACE_BITS = 24
MEASURES = ("words", "word_chars", "symbols", "repeated_lines", "repeated_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    return F.aggregate(F.array(lines), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x)))


def _same(x: Column, y: Column) -> Column:
    """Whether two packed windows agree in all bits above the position."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0


def _twins(rows: str, same) -> Column:
    """Entries of a sorted array that equal a neighbour."""
    return F.filter(rows, lambda x, i: F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, i - 1)), F.lit(False)))


def measured(transcripts: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the measures of the whole ``text``.

    A word is in a repeated window when a window of three words that holds it occurs twice or more. Windows are
    hashed; the upper bits of each hash, with the window's position in the lower ones, are sorted as plain numbers, equal
    neighbours keep their positions, and the union of their windows is measured. Where neighbours agree in the upper
    bits alone, or positions need more bits than there are, that text sorts the whole hashes instead.
    """
    rows = transcripts.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(*keep, "_text", _words(F.col("_text")).alias("_w"))
    hashed = lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))
    rows = rows.select(
        *keep,
        F.size("_w").cast("bigint").alias("words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, F.col("_text")))).cast("bigint").alias("symbols"),
        _repeated_lines(F.col("_text")).cast("bigint").alias("repeated_lines"),
        F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), hashed).alias("_h"),
    )
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    packed = F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("bigint")))
    # Most texts repeat no window: for those the rest is skipped.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.select(*keep, *MEASURES[:4], "_h", F.when(repeats, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("_s"))
    rows = rows.select(*keep, *MEASURES[:4], "_h", _twins("_s", _same).alias("_t"))
    # Within the twins: neighbours with the same upper bits whose hashes differ.
    clash = F.exists(
        F.transform("_t", lambda x, i: _same(x, F.get("_t", i + 1)) & (F.get("_h", place(x)) != F.get("_h", place(F.get("_t", i + 1))))),
        lambda x: F.coalesce(x, F.lit(False)),
    )
    whole = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*keep, *MEASURES[:4], "_t", F.when((F.size("_h") > 1 << PLACE_BITS) | clash, whole).alias("_f"))
    places = F.when(
        F.col("_f").isNotNull(), F.transform(_twins("_f", lambda x, y: x["h"] == y["h"]), lambda x: x["i"])
    ).otherwise(F.transform("_t", place))
    rows = rows.select(*keep, *MEASURES[:4], F.sort_array(places).alias("_p"))
    covered = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    return rows.select(*keep, *MEASURES[:4], F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("repeated_words"))


def folder_rates(measures: DataFrame, prior: tuple[float, float]) -> DataFrame:
    """Files, failures and shrunken failure rate of each folder: the mean of the beta posterior."""
    alpha, beta = prior
    per = measures.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("base_failed").cast("bigint")).alias("failures"))
    return per.withColumn("folder_rate", (F.col("failures") + F.lit(alpha)) / (F.col("files") + F.lit(alpha + beta)))


def beta_prior(measures: DataFrame, least: float = 2.0, most: float = 1e4) -> tuple[float, float]:
    """Beta distribution of the folders' failure rates by moments: the pooled mean, and the variance between folders
    beyond what their sizes explain. ``least`` and ``most`` bound its weight in files, also where no variance is left;
    without any file it is even. Only one row of sums comes to the driver."""
    per = folder_rates(measures, (0.0, 1.0)).withColumn("p", F.col("failures") / F.col("files"))
    sums = per.agg(
        F.sum("files").alias("n"),
        F.sum("failures").alias("f"),
        F.count(F.lit(1)).alias("folders"),
        F.sum(F.col("files") * F.col("p") * F.col("p")).alias("squares"),
    ).first()
    if not sums.n:
        return least / 2, least / 2
    mean = sums.f / sums.n
    spread = mean * (1 - mean)
    between = sums.squares / sums.n - mean * mean - spread * sums.folders / sums.n
    weight = spread / between - 1 if between > 0 else most
    weight = min(max(weight, least), most)
    # Never quite 0 or 1, so that one sort of file alone says nothing certain of the next folder.
    mean = min(max(mean, 1 / (sums.n + 2)), 1 - 1 / (sums.n + 2))
    return mean * weight, (1 - mean) * weight


def judge_transcripts(
    transcripts: DataFrame, min_words: int = 50, max_repeated_percent: int = 50, max_folder_rate: float = 0.8
) -> DataFrame:
    """Measures and verdict of every transcript; a folder whose files fail almost always is rejected as a whole.

    ``file_id, folder, text`` to ``file_id, folder, words, word_chars, symbols, repeated_lines, repeated_words,
    base_failed, folder_rate, kept``; the folder is the host that a recording was found on. A text fails the base
    rules with fewer than ``min_words`` words, or when over ``max_repeated_percent`` of its words lie in repeated
    three-word windows. Failures are added up by folder, rates shrunk with the beta prior that the folders
    themselves suggest, and a folder at ``max_folder_rate`` or more rejects all its files.

    Null and empty texts have no words, so fail. A null folder is a folder. Repeated rows count and return one
    by one, further columns are ignored whatever their names, and an empty table gives no rows. A folder with a
    third of all files costs one partial sum per task.
    """
    rows = transcripts.select(F.col("file_id"), F.col("folder"), F.col("text"))
    failed = (F.col("words") < min_words) | (100 * F.col("repeated_words") > max_repeated_percent * F.col("words"))
    measures = cut_lineage(measured(rows, ["file_id", "folder"]).withColumn("base_failed", failed))
    rates = folder_rates(measures, beta_prior(measures)).select(F.col("folder").alias("_folder"), "folder_rate")
    joined = measures.join(rates, F.col("folder").eqNullSafe(F.col("_folder")), "left").drop("_folder")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("folder_rate") < max_folder_rate))
