"""Word edit distance of transcripts of any length: tiles of the distance table, in diagonal waves.

A transcript is rows of bounded blocks of words. A tile meets one block of each side; what it must know of its
neighbours are the differences along its edges, one bit for a rise and one for a fall of every cell, and that is what
it hands on. Tiles on one diagonal need nothing of each other, so a wave is one job over all recordings at once;
recordings of one block a side, which most are, need one wave.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import tokenize
from voxtide.operators.ordered import block_of, blocked_by, running_sum
from voxtide.session import cut_lineage, shared_dir, ship_package

# Words of a block: a tile's table has the square of this, a machine word for each 64 cells.
BLOCK_WORDS = 4_096
_TILE = "file_id {kind}, i bigint, j bigint, down binary, along binary, delta bigint"


def _bytes(rise: int, fall: int, size: int) -> bytes:
    width = (size + 7) // 8
    return rise.to_bytes(width, "little") + fall.to_bytes(width, "little")


def _bits(edge: bytes | None, size: int) -> tuple[int, int]:
    """Rises and falls along an edge; at the border of the whole table every cell is one more than the last."""
    if edge is None:
        return (1 << size) - 1, 0
    width = (size + 7) // 8
    return int.from_bytes(edge[:width], "little"), int.from_bytes(edge[width:], "little")


def tile(a: list[str], b: list[str], left: bytes | None, top: bytes | None) -> tuple[bytes, bytes, int]:
    """The right and the lower edge of a tile from its left and upper one, and how much its right edge rises in all.

    Words of ``a`` are the rows, a bit each; words of ``b`` are taken one after the other (Myers 1999, in blocks).
    """
    rows, columns = len(a), len(b)
    where: dict[str, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | 1 << i
    full, last = (1 << rows) - 1, 1 << (rows - 1)
    rise, fall = _bits(left, rows)
    top_rise, top_fall = _bits(top, columns)
    low_rise = low_fall = 0
    get = where.get
    for j, word in enumerate(b):
        bit = 1 << j
        up, down = top_rise & bit, top_fall & bit
        same = get(word, 0)
        vertical = same | fall
        if down:
            same |= 1
        across = (((same & rise) + rise) ^ rise) | same
        high = fall | (full & ~(across | rise))
        low = rise & across
        if high & last:
            low_rise |= bit
        elif low & last:
            low_fall |= bit
        high, low = (high << 1) & full, (low << 1) & full
        if down:
            low |= 1
        elif up:
            high |= 1
        rise = low | (full & ~(vertical | high))
        fall = high & vertical
    return _bytes(rise, fall, rows), _bytes(low_rise, low_fall, columns), rise.bit_count() - fall.bit_count()


def word_blocks(texts: DataFrame, normalized: bool = False, size: int = BLOCK_WORDS) -> DataFrame:
    """Words of ``texts(file_id, idx, text)`` in order, as ``file_id, block, words``: numbered by running sums over the
    texts' own counts, so that no row holds more than a block or one text."""
    rows = texts.select("file_id", "idx", tokenize(F.col("text"), normalized).alias("_t"))
    rows, block = blocked_by(rows, ["file_id"], block_of(F.col("idx")))
    rows = running_sum(rows, ["file_id"], block, ["idx"], F.size("_t").cast("bigint"), "_upto")
    first = F.col("_upto") - F.size("_t")
    words = rows.select("file_id", first.alias("_first"), F.posexplode("_t").alias("_k", "word"))
    placed = words.select("file_id", (F.col("_first") + F.col("_k")).alias("_at"), "word")
    blocks = placed.groupBy("file_id", F.expr(f"_at div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_w"))
    return blocks.select("file_id", "block", F.transform("_w", lambda w: w["word"]).alias("words"))


def _sizes(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.groupBy("file_id").agg(F.count(F.lit(1)).alias(f"{name}_blocks"), F.sum(F.size("words")).cast("bigint").alias(f"{name}_words"))


def tiled_edits(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Word edit distance per recording of ``word_blocks``: ``file_id, expected_words, actual_words, word_edits``.

    Recordings are those of either side; one without words on a side costs all words of the other. Every wave joins
    tiles with the edges that the wave before wrote in the shared folder, by recording and block.
    """
    ship_package(expected.sparkSession)
    a = cut_lineage(expected.select("file_id", F.col("block").alias("i"), F.col("words").alias("a")))
    b = cut_lineage(actual.select("file_id", F.col("block").alias("j"), F.col("words").alias("b")))
    sizes = _sizes(a.withColumnRenamed("a", "words"), "a").join(_sizes(b.withColumnRenamed("b", "words"), "b"), "file_id", "full")
    sizes = cut_lineage(sizes.na.fill(0))
    both = sizes.filter("a_blocks > 0 AND b_blocks > 0")
    waves = both.agg(F.max(F.col("a_blocks") + F.col("b_blocks") - 1)).first()[0] or 0
    spark = a.sparkSession
    folder = os.path.join(shared_dir(spark), f"tiles-{uuid.uuid4().hex}")
    schema = _TILE.format(kind=a.schema["file_id"].dataType.simpleString())

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, i, j, x, y, left, top in zip(*(batch[c] for c in ("file_id", "i", "j", "a", "b", "left", "top"))):
                right, lower, delta = tile(list(x), list(y), left, top)
                out.append((file_id, i, j, right, lower, delta))
            yield pd.DataFrame(out, columns=["file_id", "i", "j", "down", "along", "delta"])

    before = spark.createDataFrame([], schema)
    for wave in range(waves):
        # Only recordings that reach this diagonal take part in it.
        tiles = a.withColumn("j", F.lit(wave) - F.col("i")).filter("j >= 0").join(b, ["file_id", "j"])
        if wave:
            lefts = before.select("file_id", "i", F.col("down").alias("left"))
            tops = before.select("file_id", "j", F.col("along").alias("top"))
            tiles = tiles.join(lefts, ["file_id", "i"], "left").join(tops, ["file_id", "j"], "left")
            # On the borders of the table the edge is the border's own.
            tiles = tiles.withColumn("left", F.expr("IF(j = 0, NULL, left)")).withColumn("top", F.expr("IF(i = 0, NULL, top)"))
        else:
            tiles = tiles.withColumns({"left": F.lit(None).cast("binary"), "top": F.lit(None).cast("binary")})
        tiles.select("file_id", "i", "j", "a", "b", "left", "top").mapInPandas(compute, schema).write.parquet(f"{folder}/wave={wave}")
        before = spark.read.schema(schema).parquet(f"{folder}/wave={wave}")
    done = spark.read.schema(schema).parquet(*(f"{folder}/wave={wave}" for wave in range(waves))) if waves else before
    # Along the upper border to its end, then down the last column.
    falls = done.join(both.select("file_id", "b_blocks"), "file_id").filter("j = b_blocks - 1").groupBy("file_id").agg(F.sum("delta").alias("_down"))
    edits = F.when((F.col("a_blocks") > 0) & (F.col("b_blocks") > 0), F.col("b_words") + F.col("_down")).otherwise(F.col("a_words") + F.col("b_words"))
    return sizes.join(falls, "file_id", "left").select(
        "file_id", F.col("a_words").alias("expected_words"), F.col("b_words").alias("actual_words"), edits.cast("bigint").alias("word_edits")
    )
