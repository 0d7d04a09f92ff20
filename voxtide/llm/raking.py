"""Mixes transcripts of many sources to target weights by iterative proportional fitting. Column functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtide.session import cut_lineage

# Cells sent to every executor; a larger cell table is shuffled instead.
BROADCAST_CELLS = 50_000

Targets = Mapping[str | None, float] | float


def topic_of(text: Column, topics: Mapping[str, Sequence[str]], otherwise: str = "prose") -> Column:
    """The first topic one of whose terms occurs in the text, else ``otherwise``; null texts have that too."""
    found = F.lit(otherwise)
    for topic, terms in reversed(topics.items()):
        found = F.when(reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in terms]), topic).otherwise(found)
    return found


def margin_targets(cells: DataFrame, margin: str, targets: Targets, total: float) -> DataFrame:
    """Tokens that each value of a margin should have, adding up to ``total`` over the values that occur.

    Given weights are taken in proportion, a value without one has 0; a number stands for the values' own tokens to that power.
    """
    values = cells.groupBy(margin).agg(F.sum("tokens").alias("_own"))
    if isinstance(targets, (int, float)):
        weighted = values.select(F.col(margin).alias("_value"), F.pow("_own", F.lit(float(targets))).alias("_w"))
    else:
        kind = cells.schema[margin].dataType.simpleString()
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"_value {kind}, _w double")
        weighted = values.join(given, values[margin].eqNullSafe(given["_value"]), "left").select(F.col(margin).alias("_value"), F.coalesce("_w", F.lit(0.0)).alias("_w"))
    weighted = cut_lineage(weighted)
    mass = weighted.agg(F.sum("_w")).first()[0] or 0.0
    return weighted.select("_value", (F.col("_w") * (total / mass if mass else 0.0)).alias(f"_{margin}"))


def rake(cells: DataFrame, targets: Mapping[str, Targets], sweeps: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """Factor of each cell so that its weighted tokens meet the target of every margin.

    ``cells`` has one row, with its sum of ``tokens``, for each combination of the margins (the keys of ``targets``)
    that occurs. A sweep scales to each margin in turn; sweeps go on until no margin is off by over ``tolerance`` of
    all tokens, at most ``sweeps`` times where the targets contradict each other. Returns the cells with ``factor`` and
    ``margin_error``, how far the worst margin was off in the last sweep, as a share of all tokens: over ``tolerance`` it
    says that the fitting did not converge.

    All of it works on the cell table, which has a row for each combination and not for each document.
    """
    margins = list(targets)
    now = cells.select(*margins, F.col("tokens").cast("double").alias("tokens"))
    total = now.agg(F.sum("tokens")).first()[0] or 0.0
    for margin, wanted in targets.items():
        want = margin_targets(now, margin, wanted, total)
        now = now.join(want, now[margin].eqNullSafe(want["_value"]), "left").drop("_value")
    now, error = cut_lineage(now.withColumn("factor", F.lit(1.0))), 0.0
    for _ in range(sweeps):
        off = []
        for margin in margins:
            has = F.sum(F.col("tokens") * F.col("factor")).over(Window.partitionBy(margin))
            now = now.withColumn("_has", has).withColumn(f"_off_{margin}", F.abs(F.col("_has") - F.col(f"_{margin}")))
            now = now.withColumn("factor", F.when(F.col("_has") > 0, F.col("factor") * F.col(f"_{margin}") / F.col("_has")).otherwise(0.0))
            off.append(f"_off_{margin}")
        now = cut_lineage(now.drop("_has"))
        worst = now.agg(*[F.max(c) for c in off]).first()
        now = now.drop(*off)
        error = max((x or 0.0 for x in worst), default=0.0) / total if total else 0.0
        if error <= tolerance:
            break
    return now.select(*margins, "tokens", "factor", F.lit(error).alias("margin_error"))


def calibrated_scale(raked: DataFrame, share: float) -> float:
    """The scale s at which drawing with probability min(1, s * factor) is expected to give ``share`` of all tokens.

    Cells that reach 1 are set aside and the scale of the rest grows, until no further cell does; infinite where
    even everything with a factor is not enough.
    """
    sums = raked.agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("factor")).alias("weighted")).first()
    budget = share * (sums["all"] or 0.0)
    if not sums.weighted:
        return 0.0
    scale = budget / sums.weighted
    while True:
        full = F.col("factor") * scale >= 1
        sums = raked.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("factor"))).alias("rest"),
        ).first()
        if not sums.rest:
            return scale if budget <= sums.full else float("inf")
        last, scale = scale, max(scale, (budget - sums.full) / sums.rest)
        if scale <= last * (1 + 1e-12):
            return last


def mix_transcripts(
    transcripts: DataFrame,
    targets: Mapping[str, Targets],
    share: float = 0.7,
    seed: int = 0,
    sweeps: int = 50,
    tolerance: float = 1e-6,
) -> DataFrame:
    """All columns of the transcripts with ``weight``, ``probability``, ``sampled`` and ``margin_error``.

    Input columns are ``file_id``, ``tokens`` and the margins that ``targets`` names, as ``folder``, ``language`` and
    ``topic``; for each margin the wanted weights of its values, or a power of their own tokens (1 leaves the mix,
    0 evens it out). Token weights are raked to the margins; a transcript's ``probability`` is its weight times the
    scale at which ``share`` of all tokens are expected, at most 1. Where no cell reaches 1, the expected tokens of
    every margin are in the wanted proportion; a smaller share leaves more room. ``sampled`` compares the probability with a
    number drawn from a hash of ``seed`` and ``file_id``: the same in every run and partition. ``margin_error`` is how far the
    worst margin is from its target, as a share of all tokens: over ``tolerance`` where ``sweeps`` did not suffice.

    A null value of a margin is a value. Null or negative tokens count as 0, but such rows are drawn with their
    cell; a cell without tokens keeps the factor of its margins. Repeated ids have the same draw, null ids as well.
    Columns named like the four new ones are replaced, others pass through; an empty table gives no rows.
    """
    rows = transcripts.drop("weight", "probability", "sampled", "margin_error")
    counted = rows.groupBy(*targets).agg(F.sum(F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))).alias("tokens"))
    raked = rake(cut_lineage(counted), targets, sweeps, tolerance)
    scale = calibrated_scale(raked, share)
    factors = cut_lineage(raked.select(*[F.col(m).alias(f"_m{i}") for i, m in enumerate(targets)], F.col("factor").alias("weight"), "margin_error"))
    if factors.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    same = reduce(Column.__and__, [rows[m].eqNullSafe(F.col(f"_m{i}")) for i, m in enumerate(targets)])
    # The first 48 bits of the digest, as a number from 0 up to 1.
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("file_id").cast("string"), F.lit("")))), 1, 12)
    draw = F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 48))
    return (
        rows.join(factors, same, "left")
        .withColumn("probability", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale))).otherwise(0.0))
        .withColumn("sampled", draw < F.col("probability"))
        .select(*rows.columns, "weight", "probability", "sampled", "margin_error")
    )
