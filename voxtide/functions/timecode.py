"""Sample, millisecond and text forms of a position on the timeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtide.options import MS_PER_SECOND, SAMPLE_RATE


def int_div(left: Column, right: int | Column) -> Column:
    """Integral division, which the Column API lacks as an operator."""
    return F.call_function("div", left, right if isinstance(right, Column) else F.lit(right))


def _non_negative(value: Column, what: str, then: Column) -> Column:
    return F.when(value < 0, F.raise_error(F.lit(f"{what} cannot be negative"))).otherwise(then)


def samples_to_ms(samples: Column) -> Column:
    """Nearest millisecond, halves up; a negative position is an error."""
    n = samples.cast("bigint")
    return _non_negative(n, "sample position", int_div(n * MS_PER_SECOND + SAMPLE_RATE // 2, SAMPLE_RATE))


def ms_to_samples(ms: Column) -> Column:
    return ms.cast("bigint") * (SAMPLE_RATE // MS_PER_SECOND)


def format_timestamp(ms: Column) -> Column:
    """HH:MM:SS.mmm with at least two hour digits."""
    n = ms.cast("bigint")
    text = F.format_string(
        "%02d:%02d:%02d.%03d",
        int_div(n, 3_600_000),
        int_div(n, 60_000) % 60,
        int_div(n, 1_000) % 60,
        n % 1_000,
    )
    return _non_negative(n, "timestamp", text)


def parse_timestamp(text: Column) -> Column:
    """Milliseconds, or null when the text is not a caption timestamp."""
    parts = F.split(text, ":")
    ok = text.rlike(r"\A[0-9]{2,}:[0-5][0-9]:[0-5][0-9]\.[0-9]{3}\z")
    hours = F.expr("try_cast(null as bigint)")
    hours = F.when(ok, parts[0].try_cast("bigint")).otherwise(hours)
    rest = (
        parts[1].try_cast("bigint") * 60_000
        + F.substring(parts[2], 1, 2).try_cast("bigint") * 1_000
        + F.substring(parts[2], 4, 3).try_cast("bigint")
    )
    return F.when(ok, F.try_add(F.try_multiply(hours, F.lit(3_600_000)), rest))


def format_duration(seconds: Column) -> Column:
    """H:MM:SS from one hour up, else M:SS; negative durations show as zero."""
    n = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    minute, second = int_div(n, 60) % 60, n % 60
    return F.when(n >= 3_600, F.format_string("%d:%02d:%02d", int_div(n, 3_600), minute, second)).otherwise(
        F.format_string("%d:%02d", int_div(n, 60), second)
    )
