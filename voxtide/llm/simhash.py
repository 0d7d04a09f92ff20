"""SimHash near-duplicates of transcripts, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxtide.llm.components import connected
from voxtide.session import cut_lineage

BITS = 64
# Shingles whose bits are counted at once.
CHUNK = 65_536


def fingerprint_of(text: bytes, width: int, seed: int) -> int:
    """SimHash of one text as a signed 64-bit number.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly A-Z and the white space 20, 09-0D.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(width, len(words))
    digest = xxhash.xxh64_digest
    total = np.zeros(BITS, dtype=np.int64)
    n = len(words) - width + 1
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)], starts[at + width : at + CHUNK + width])
        hashes = np.frombuffer(b"".join([digest(line[i : j - 1], seed) for i, j in spans]), dtype=np.uint8)
        total += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def transcript_fingerprints(transcripts: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``file_id, text`` to ``file_id, fingerprint`` (bigint); null and wordless texts have fingerprint 0. Ids of any type."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = [fingerprint_of(t.as_py() or b"", width, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["file_id", "fingerprint"])

    rows = transcripts.select("file_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fingerprints, StructType([rows.schema["file_id"], StructField("fingerprint", LongType())]))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def segment_plan(segments: int, distance: int) -> list[tuple[int, int]]:
    """Mask and search radius of each segment of the fingerprint.

    With distance = segments * r + a, two fingerprints in reach agree to r bits in one of the first a + 1 segments or
    to r - 1 bits in one of the others: otherwise the distances would add up to more. A radius under 0 needs no search.
    """
    if not 0 < segments <= BITS:
        raise ValueError("segments must be between 1 and 64")
    radius, rest = divmod(distance, segments)
    plan, low = [], 0
    for k in range(segments):
        width = (BITS - low) // (segments - k)
        plan.append((((1 << width) - 1) << low, radius if k <= rest else radius - 1))
        low += width
    return [(mask, r) for mask, r in plan if r >= 0]


def ball(mask: int, radius: int) -> list[int]:
    """All sets of at most ``radius`` bits of ``mask``, as numbers to combine with exclusive or."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [_signed(sum(chosen)) for r in range(radius + 1) for chosen in combinations(bits, r)]


def _entries(prints: DataFrame, plan: list[tuple[int, int]], probe: bool) -> DataFrame:
    """Table number ``t`` and key ``v`` of each fingerprint: its segments, or every value in their Hamming balls."""
    tables = []
    for k, (mask, radius) in enumerate(plan):
        segment = F.col("fingerprint").bitwiseAND(F.lit(_signed(mask)))
        flips = F.array(*map(F.lit, ball(mask, radius if probe else 0)))
        tables.append(prints.select("fingerprint", F.lit(k).alias("t"), segment.alias("s"), F.explode(flips).alias("f")))
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.union(more)
    return rows.select("fingerprint", "t", F.col("s").bitwiseXOR(F.col("f")).alias("v"))


def _around(prints: DataFrame, radius: int) -> DataFrame:
    """All values ``centre`` within ``radius`` bits of each fingerprint, once each: bits are flipped in rising order, and 64
    stands for no further flip."""
    near = prints.select("fingerprint", F.lit(-1).alias("i"), F.col("fingerprint").alias("centre"))
    for _ in range(radius):
        near = near.select("fingerprint", "centre", F.explode(F.expr("IF(i < 64, sequence(i + 1, 64), array(64))")).alias("i"))
        near = near.withColumn("centre", F.expr("centre ^ IF(i < 64, shiftleft(1L, i), 0L)"))
    return near.select("fingerprint", "centre")


def _centres(prints: DataFrame, distance: int) -> DataFrame:
    """Links, without pairs, between fingerprints at most ``distance`` bits apart: those have a value within half of it
    (rounded up) of one and half of it (rounded down) of the other, and what shares one so is no further apart."""
    near = _around(prints, (distance + 1) // 2)
    closest = near if distance % 2 == 0 else _around(prints, distance // 2)
    first = closest.groupBy("centre").agg(F.min("fingerprint").alias("b"))
    return near.join(first, "centre").filter("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b").distinct()


def fingerprint_links(prints: DataFrame, distance: int = 4, segments: int = 3, crowded: int = 2_000) -> DataFrame:
    """Links ``a, b`` that join the distinct bigints ``fingerprint`` exactly as all pairs in reach would.

    Multi-index hashing: one table per segment; each fingerprint looks up the values in a small Hamming ball around
    its own segment and the whole distance of what it meets is verified. Every pair within ``distance`` meets.

    A table entry with over ``crowded`` fingerprints (many variants of one text) is not paired: what meets in it is
    linked through common centres, which costs a fixed number of rows for each fingerprint however many there are (2,081
    at a distance of 4, 65 at 2, 43,745 at 6); the centres link nothing else. Segments should have about as many bits as
    the number of fingerprints: 3 up to some hundred million, 2 above.
    """
    plan = segment_plan(segments, distance)
    table, probes = _entries(prints, plan, probe=False), _entries(prints, plan, probe=True)
    full = cut_lineage(table.groupBy("t", "v").count().filter(F.col("count") > crowded).select("t", "v"))
    hubs = None
    if not full.isEmpty():
        hubs = _centres(probes.join(full, ["t", "v"]).select("fingerprint").distinct(), distance)
        table = table.join(full, ["t", "v"], "left_anti")
    met = probes.withColumnRenamed("fingerprint", "a").join(table.withColumnRenamed("fingerprint", "b"), ["t", "v"])
    links = met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    return links.union(hubs) if hubs is not None else links


def near_transcripts(
    transcripts: DataFrame, width: int = 4, distance: int = 4, seed: int = 42, segments: int = 3, crowded: int = 2_000
) -> DataFrame:
    """Groups of transcripts whose SimHash fingerprints lie within ``distance`` bits, directly or through others.

    ``file_id, text`` to ``file_id, fingerprint`` (bigint) and ``component_id``, the smallest ``file_id`` reachable; ids
    are of any type that has an order, such as the paths of bulk transcription.
    Further columns of the input are ignored. Shingles are ``width`` words in lower case (A-Z only), counted as often
    as they occur. Null, empty and wordless texts have fingerprint 0 and form a group like any other. Repeated
    ``file_id`` values keep one row each; a null ``file_id`` gives a row that belongs to its fingerprint's group
    and never names it (the group of nothing else has a null component). An empty table gives no rows.

    Copies meet once, as one fingerprint, so the number of copies of a text costs nothing beyond its own rows.
    """
    prints = cut_lineage(transcript_fingerprints(transcripts, width, seed))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("file_id").alias("lowest")))
    parts = connected(fingerprint_links(distinct.select("fingerprint"), distance, segments, crowded), "a", "b")
    named = distinct.join(parts.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "lowest", F.coalesce("component_id", "fingerprint").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    groups = named.select("fingerprint", "root").join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(groups, "fingerprint").select("file_id", "fingerprint", "component_id")


def fingerprint_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits of a bigint fingerprint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
