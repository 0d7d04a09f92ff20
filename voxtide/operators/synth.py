"""Seeded synthetic recordings. Every draw is a hash of the seed, a scope and the row, so it needs no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.timecode import int_div
from voxtide.options import SAMPLE_RATE


def draw(seed: int, scope: str, *parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(scope), *parts), F.lit(1 << 52)) / float(1 << 52)


def draw_between(low: Column, high: Column, seed: int, scope: str, *parts: Column) -> Column:
    """Whole number from low to high, both included."""
    return low + F.floor(draw(seed, scope, *parts) * (high - low + 1)).cast("bigint")


def allocate_slack(rows: DataFrame, seed: int, key: str = "file_id") -> DataFrame:
    """Spreads ``slack`` over an array of ``capacities``; adds ``extra``, which sums to the slack exactly.

    Each place draws between what the later places cannot take and what it may take itself.
    """
    zero = F.lit(0).cast("bigint")
    total = F.aggregate("capacities", zero, lambda a, c: a + c)
    guarded = F.when(F.col("slack") > total, F.raise_error(F.lit("slack exceeds the capacities")).cast("bigint")).otherwise(F.col("slack"))

    def step(acc: Column, place: Column) -> Column:
        after = acc["after"] - place["c"]
        low, high = F.greatest(zero, acc["left"] - after), F.least(place["c"], acc["left"])
        taken = draw_between(low, high, seed, "slack", F.col(key), place["i"])
        return F.struct((acc["left"] - taken).alias("left"), after.alias("after"), F.concat(acc["extra"], F.array(taken)).alias("extra"))

    start = F.struct(guarded.alias("left"), total.alias("after"), F.array().cast("array<bigint>").alias("extra"))
    places = F.transform("capacities", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return rows.withColumn("extra", F.aggregate(places, start, step, lambda acc: acc["extra"]))


def assign_strata(rows: DataFrame, key: str, strata: list[int], minimum: int, seed: int) -> DataFrame:
    """Gives every row a stratum, each at least ``minimum`` times, the rest at random.

    The rows with the lowest hashes fill the guaranteed places; only those few are ranked.
    """
    guaranteed = minimum * len(strata)
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit("place"), F.col(key)))
    lowest = hashed.orderBy("_h", key).limit(guaranteed).select(key, "_h")
    members = lowest.agg(F.array_sort(F.collect_list(F.struct("_h", key))).alias("m"))
    ranked = members.select(F.posexplode("m").alias("_rank", "m")).select(F.col(f"m.{key}").alias(key), "_rank")
    choices = F.array(*map(F.lit, strata))
    fixed = F.element_at(choices, (F.col("_rank") % len(strata) + 1).cast("int"))
    free = F.element_at(choices, draw_between(F.lit(1), F.lit(len(strata)), seed, "stratum", F.col(key)).cast("int"))
    placed = hashed.join(F.broadcast(ranked), key, "left")
    return placed.withColumn("stratum", F.coalesce(fixed, free)).drop("_h", "_rank")


# Utterance counts and target seconds per duration band.
_BANDS = (("short", 4, 5, 34, 54), ("medium", 7, 8, 58, 85), ("long", 10, 11, 82, 115))
_SUBJECTS = ("a heron", "the ferry", "one lantern", "our neighbour", "that orchard", "the tide")
_ACTIONS = ("waits beside", "drifts past", "remembers", "circles", "borrows light from", "outlasts")
_PLACES = ("the stone pier", "an empty market", "the salt road", "a winter garden", "the old mill", "seven hills")


def corpus(ids: DataFrame, seed: int, key: str = "file_id") -> DataFrame:
    """Synthetic recordings, one per id: a band, utterances with text and places, and silences that fill the rest.

    Bands take turns by id, so they have equal size where ids are dense.
    """
    band = (F.col(key) % len(_BANDS)).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in _BANDS]), band + 1)
    rows = ids.select(key, pick(0).alias("band"), draw_between(pick(1), pick(2), seed, "count", F.col(key)).cast("int").alias("_n"),
                      draw_between(pick(3), pick(4), seed, "target", F.col(key)).alias("_target"))
    word = lambda words, scope, i: F.element_at(
        F.array(*map(F.lit, words)), draw_between(F.lit(1), F.lit(len(words)), seed, scope, F.col(key), i).cast("int")
    )
    lengths = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: draw_between(F.lit(5 * SAMPLE_RATE), F.lit(6 * SAMPLE_RATE), seed, "length", F.col(key), i),
    )
    text = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.concat_ws(" ", word(_SUBJECTS, "subject", i), word(_ACTIONS, "action", i), word(_PLACES, "place", i)),
    )
    rows = rows.withColumn("_lengths", lengths).withColumn("_text", text)
    spoken = F.aggregate("_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    least_gap, gap_room, edge = SAMPLE_RATE * 3 // 4, SAMPLE_RATE * 9 // 4, 2 * SAMPLE_RATE
    fixed = spoken + (F.col("_n") - 1) * least_gap
    room = (F.col("_n") - 1) * gap_room + 2 * edge
    slack = F.least(F.greatest(F.col("_target") * SAMPLE_RATE - fixed, F.lit(0)), room).cast("bigint")
    inner = F.array_repeat(F.lit(gap_room).cast("bigint"), F.col("_n") - 1)
    edges = F.array(F.lit(edge).cast("bigint"))
    rows = allocate_slack(rows.withColumn("slack", slack).withColumn("capacities", F.concat(edges, inner, edges)), seed, key)
    rows = rows.withColumn("total_samples", fixed + F.col("slack"))

    def place(acc: Column, i: Column) -> Column:
        gap = F.get("extra", i) + F.when(i > 0, least_gap).otherwise(0)
        start = acc["at"] + gap
        end = start + F.get("_lengths", i)
        item = F.struct(start.alias("start_sample"), end.alias("end_sample"), gap.alias("gap_before"), F.get("_text", i).alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["u"], F.array(item)).alias("u"))

    kind = "array<struct<start_sample:bigint,end_sample:bigint,gap_before:bigint,text:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("u"))
    placed = F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), start, place, lambda acc: acc["u"])
    return rows.select(key, "band", placed.alias("utterances"), F.element_at("extra", -1).alias("trailing_silence"), "total_samples")


def fill_duration(rows: DataFrame) -> DataFrame:
    """Repeats a unit, each followed by a gap, while another whole one fits ``target``; the rest is the tail.

    ``rows(file_id, unit, gap, target)`` gives one row per repetition with its range, the count and the tail.
    """
    n = int_div(F.col("target") + F.col("gap"), F.col("unit") + F.col("gap"))
    left = F.col("target") - n * (F.col("unit") + F.col("gap"))
    fits = rows.filter((F.col("unit") > 0) & (F.col("unit") <= F.col("target")))
    counted = fits.withColumn("repetitions", n).withColumn("tail", F.greatest(left, F.lit(0)))
    each = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("repetitions") - 1)).alias("rep"))
    start = F.col("rep") * (F.col("unit") + F.col("gap"))
    return each.select("file_id", "rep", start.alias("start_sample"), (start + F.col("unit")).alias("end_sample"), "repetitions", "tail")
