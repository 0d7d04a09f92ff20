"""Removes lines that many transcript documents share, by bitmaps of the lines to keep. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtide.session import cut_lineage

# Stretches that the documents holding a line are dealt to, so that a line found everywhere is no one task's work.
STRETCHES = 16
# Shared keys sent to every executor, 24 bytes each; more of them are joined by a shuffle that Spark can split.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tag() -> Column:
    """Tells rows of one ``file_id`` apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row for each long line: 128 bits of its key's hash, stretch, document, position."""
    rows = documents.filter("file_id IS NOT NULL AND text IS NOT NULL").select("file_id", _tag().alias("tag"), F.split("text", "\n").alias("l"))
    lines = rows.select("file_id", "tag", F.posexplode("l").alias("line_no", "line"))
    # Trimming only shortens: most short lines need no key.
    keyed = lines.filter(F.length("line") >= min_chars).withColumn("k", line_key(F.col("line"))).filter(F.length("k") >= min_chars)
    stretch = F.pmod(F.xxhash64("file_id"), F.lit(STRETCHES)).cast("tinyint")
    return keyed.select(
        F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), stretch.alias("stretch"), "file_id", "tag", "line_no"
    )


def keep_bitmaps(documents: DataFrame, min_chars: int = 20, min_files: int = 3) -> DataFrame:
    """Which lines of which documents go: ``file_id, tag, keep_bitmap, dropped``, only for documents that lose some.

    Line hashes are range-partitioned and sorted by document, largest first, and position; passing through a
    key's run, the first row is its last document and each change of document counts one more. A key's documents are
    dealt to ``STRETCHES`` runs, whose counts are added up with partial sums, so that a line found everywhere
    is spread as well. A key found in ``min_files`` documents goes from all but the last of them.

    ``keep_bitmap`` is a run-length bitmap: the sorted positions where it flips, beginning with kept lines.
    """
    run = ["h1", "h2", "stretch"]
    # Ranges are sampled before they are dealt out: the texts are read once.
    keyed = cut_lineage(keyed_lines(documents, min_chars))
    passing = Window.partitionBy(*run).orderBy(F.desc("file_id"), "line_no")
    before = F.lag("file_id").over(passing)
    seen = keyed.drop("tag").repartitionByRange(*run).select("h1", "h2", "file_id", F.when(before == F.col("file_id"), 0).otherwise(1).alias("new"))
    shared = seen.groupBy("h1", "h2").agg(F.sum("new").alias("files"), F.max("file_id").alias("last")).filter(F.col("files") >= min_files)
    shared = cut_lineage(shared.select("h1", "h2", "last"))
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    gone = keyed.join(shared, ["h1", "h2"]).filter(F.col("file_id") < F.col("last"))
    lost = gone.groupBy("file_id", "tag").agg(F.sort_array(F.collect_set("line_no")).alias("d"))
    first = F.filter("d", lambda p, i: ~F.coalesce(F.get("d", i - 1) == p - 1, F.lit(False)))
    last = F.filter("d", lambda p, i: ~F.coalesce(F.get("d", i + 1) == p + 1, F.lit(False)))
    flips = F.sort_array(F.concat(first, F.transform(last, lambda p: p + 1)))
    return lost.select("file_id", "tag", flips.alias("keep_bitmap"), F.size("d").cast("bigint").alias("dropped"))


def kept_lines(text: Column, keep_bitmap: Column) -> Column:
    """The text's lines in the kept runs of ``keep_bitmap``, joined; the whole text where it is null."""
    lines = F.split(text, "\n")

    def cut(lines: Column) -> Column:
        start = lambda k: F.coalesce(F.get(keep_bitmap, 2 * k - 1), F.lit(0))
        end = lambda k: F.coalesce(F.get(keep_bitmap, 2 * k), F.size(lines))
        runs = F.sequence(F.lit(0), (F.size(keep_bitmap) / 2).cast("int"))
        return F.array_join(F.flatten(F.transform(runs, lambda k: F.slice(lines, start(k) + 1, end(k) - start(k)))), "\n")

    # As an element, the array of lines is split once and not for each run.
    return F.when(keep_bitmap.isNull(), text).otherwise(F.transform(F.array(lines), cut)[0])


def drop_shared_lines(documents: DataFrame, min_chars: int = 20, min_files: int = 3) -> DataFrame:
    """All columns of the documents, ``text`` without shared lines, and ``lines``, ``dropped`` (bigint), ``keep_bitmap``.

    Input columns are ``file_id`` (bigint), ``text`` and any others; others named like the three new ones are
    replaced. A line's key is the line trimmed of ASCII white space with A-Z in lower case. Keys of at least ``min_chars``
    characters in at least ``min_files`` documents lose all their lines except in the document with the largest
    ``file_id``; lines repeated in one document alone stay.

    A null text is one empty line and stays null, an empty one stays empty; a document without ``file_id`` counts
    for no line and loses none. Rows that share a ``file_id`` are one document, each with its own lines; the rows of
    the largest keep theirs. An empty table gives no rows.
    """
    rows = documents.drop("lines", "dropped", "keep_bitmap").withColumn("_tag", _tag())
    maps = keep_bitmaps(rows.select("file_id", "text"), min_chars, min_files).withColumnsRenamed({"file_id": "_id", "tag": "_t"})
    joined = rows.join(maps, (F.col("file_id") == F.col("_id")) & (F.col("_tag") == F.col("_t")), "left")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(
        *[kept_lines(F.col("text"), F.col("keep_bitmap")).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c not in ("lines", "dropped", "keep_bitmap")],
        F.coalesce(breaks + 1, F.lit(1)).cast("bigint").alias("lines"),
        F.coalesce("dropped", F.lit(0)).cast("bigint").alias("dropped"),
        "keep_bitmap",
    )
