"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.session import cut_lineage


def _nearer(links: DataFrame) -> DataFrame:
    """Each end of a link points past the other end to the smallest neighbour (large star)."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(smallest, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")


def _flatter(links: DataFrame) -> DataFrame:
    """What a vertex points to points to the smallest of them instead (small star)."""
    smallest = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(smallest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
    return moved.union(smallest.select("hi", F.col("m").alias("lo"))).distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Vertices of ``links`` that are not the smallest of their component: ``id, component_id``.

    ``a`` and ``b`` are bigint columns; rows with a null end and links of a vertex to itself are ignored, repeated
    links count once, no links give no rows. Alternating large and small stars (Kiveris et al., 2014): every round is
    two joins and two partial aggregations on the vertex, so the joins of a vertex with many links can be split, and
    a round never holds a component together. Rounds grow with the logarithm of the longest path.
    """
    now = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = cut_lineage(now.filter("hi > lo").distinct())
    seen = _print_of(now)
    while True:
        now = cut_lineage(_flatter(_nearer(now)))
        last, seen = seen, _print_of(now)
        if seen == last:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))


def _print_of(links: DataFrame) -> tuple:
    """Number and order-free hash sum of the links: equal when a round changed nothing."""
    mixed: Column = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())
