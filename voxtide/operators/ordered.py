"""Order-aware operators that stay parallel inside one key.

A plain window over ``partitionBy(key)`` is the cheapest plan while every key fits one task: one shuffle, shared by all
operators on that key. ``fits_one_task`` checks that. Where a key is larger, rows also carry a *block*, a column that
never decreases along the key's order, so that (key, block) groups are bounded. Work within a block is an ordinary
window; what a block needs from earlier ones is a small per-block summary, merged along the key and joined back. Only
the summaries (one row per block) then meet in one task per key. Every function takes the block column's name, or None
for the plain plan; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from voxtide.functions.timecode import int_div
from voxtide.session import cut_lineage

BLOCK = 65_536
# A key of up to this many rows is sorted by one task without strain.
KEY_ROWS = 2_000_000
# An input estimated at no more than this is not worth counting. The estimate is of compressed columns, so a key may then
# have more than KEY_ROWS rows all the same: both plans give the same rows, and the plain one spills.
SMALL_INPUT = 4 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; None on a session without a local JVM, where it cannot be asked for."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_one_task(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether no key has more rows than one task should order; counts per key only when the input is not small."""
    limit = KEY_ROWS if limit is None else limit
    size = estimated_bytes(df)
    if size is not None and size <= SMALL_INPUT:
        return True
    return df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def spread(df: DataFrame) -> DataFrame:
    """Divides a narrow input over all cores ahead of row-wise work that is heavy on the processor.

    Files with few row groups give fewer tasks than there are cores; an input that fills the cluster is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def block_of(index: Column, size: int = BLOCK) -> Column:
    """Block of a dense, non-negative index."""
    return int_div(index.cast("bigint"), size)


def time_block(ts: Column, unit: str = "minute") -> Column:
    """Block of a timestamp order; pick the unit so that one key's rows within it fit a task."""
    return F.date_trunc(unit, ts)


def blocked_by(df: DataFrame, keys: Sequence[str], block: Column, name: str = "_b", force: bool = False) -> tuple[DataFrame, str | None]:
    """The frame with its block column, or without one where every key fits one task."""
    if not force and fits_one_task(df, keys):
        return df, None
    return df.withColumn(name, block), name


def settle(df: DataFrame, block: str | None) -> DataFrame:
    """Cuts the lineage between carries: each one reads its input twice, so a chain of them would read it 2^n times."""
    return df if block is None else cut_lineage(df)


def group_columns(keys: Sequence[str], block: str | None) -> list[str]:
    return [*keys, block] if block else [*keys]


def local_window(keys: Sequence[str], block: str | None, order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group_columns(keys, block)).orderBy(*order)


def rows_to_here(keys: Sequence[str], block: str | None, order: Sequence[str]) -> WindowSpec:
    return local_window(keys, block, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks(keys: Sequence[str], block: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(block)


def carry_in(
    df: DataFrame,
    keys: Sequence[str],
    block: str | None,
    partials: dict[str, Column],
    merges: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Adds, per row, each partial aggregate merged over the key's earlier blocks (null in the first block)."""
    if block is None:
        return df.select("*", *[F.lit(None).alias(name) for name in merges])
    summary = df.groupBy(*keys, block).agg(*[value.alias(name) for name, value in partials.items()])
    earlier = _blocks(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, block, *[merge(F.col(name)).over(earlier).alias(name) for name, merge in merges.items()])
    return df.join(carried, [*keys, block])


def row_index(df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], name: str) -> DataFrame:
    """0-based position within the key."""
    carried = carry_in(df, keys, block, {"_before": F.count(F.lit(1))}, {"_before": F.sum})
    rank = F.row_number().over(local_window(keys, block, order)).cast("bigint")
    return carried.withColumn(name, F.coalesce("_before", F.lit(0)) + rank - 1).drop("_before")


def running_sum(
    df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], value: Column, name: str, inclusive: bool = True
) -> DataFrame:
    rows = df.withColumn("_v", value)
    carried = carry_in(rows, keys, block, {"_before": F.sum("_v")}, {"_before": F.sum})
    here = F.sum("_v").over(rows_to_here(keys, block, order))
    total = F.coalesce("_before", F.lit(0)) + here
    return carried.withColumn(name, total if inclusive else total - F.col("_v")).drop("_before", "_v")


def running_max(
    df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], value: Column, name: str, inclusive: bool = True
) -> DataFrame:
    """Largest value so far; ``inclusive=False`` leaves the current row out (null for the first)."""
    rows = df.withColumn("_v", value)
    carried = carry_in(rows, keys, block, {"_before": F.max("_v")}, {"_before": F.max})
    here = local_window(keys, block, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return carried.withColumn(name, F.greatest("_before", F.max("_v").over(here))).drop("_before", "_v")


def running_last(df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Latest non-null value up to and including the row."""
    rows = df.withColumn("_v", value)
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    carried = carry_in(
        rows,
        keys,
        block,
        {"_before": F.max_by("_v", place)},
        {"_before": lambda c: F.last(c, ignorenulls=True)},
    )
    here = F.last("_v", ignorenulls=True).over(rows_to_here(keys, block, order))
    return carried.withColumn(name, F.coalesce(here, F.col("_before"))).drop("_before", "_v")


def previous_row(
    df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    """Struct of the given columns taken from the row before (null for the first row of the key)."""
    packed = F.struct(*columns)
    local = F.lag(packed).over(local_window(keys, block, order))
    if block is None:
        return df.withColumn(name, local)
    carried = carry_in(df, keys, block, {"_before": F.max_by(packed, F.struct(*order))}, {"_before": F.last})
    return carried.withColumn(name, F.coalesce(local, F.col("_before"))).drop("_before")


def next_row(
    df: DataFrame, keys: Sequence[str], block: str | None, order: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    """Struct of the given columns taken from the row after (null for the last row of the key)."""
    packed = F.struct(*columns)
    local = F.lead(packed).over(local_window(keys, block, order))
    if block is None:
        return df.withColumn(name, local)
    summary = df.groupBy(*keys, block).agg(F.min_by(packed, F.struct(*order)).alias("_after"))
    following = summary.select(*keys, block, F.lead("_after").over(_blocks(keys, block)).alias("_after"))
    return df.join(following, [*keys, block]).withColumn(name, F.coalesce(local, F.col("_after"))).drop("_after")


def with_halo(df: DataFrame, index: str, block: str, size: int, reach: int) -> DataFrame:
    """Copies the last ``reach`` rows before each block into it, marked ``halo``.

    A look-back over a fixed number of rows then needs no carry: at most ``reach / size`` of the rows are doubled.
    """
    if reach > size:
        raise ValueError("the look-back cannot be longer than a block")
    own = block_of(F.col(index), size)
    serves_next = F.pmod(F.col(index), F.lit(size)) >= size - reach
    blocks = F.when(serves_next, F.array(own, own + 1)).otherwise(F.array(own))
    copies = df.select("*", F.explode(blocks).alias(block))
    return copies.withColumn("halo", F.col(block) != own)
