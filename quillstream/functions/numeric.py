"""Small arithmetic the engine needs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(a: Column | str, n: int) -> Column:
    """Rounds towards minus infinity, unlike ``div``."""
    return F.floor(_col(a) / F.lit(n)).cast("bigint")


def half_up(a: Column | str) -> Column:
    return F.floor(_col(a) + 0.5).cast("bigint")


def half_even(a: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(a), digits)


def percent(part: Column | str, rest: Column | str) -> Column:
    """Whole percent of part in part + rest, 0 if both are."""
    n = _col(part) + _col(rest)
    return F.when(n > 0, half_up(_col(part) * 100.0 / n)).otherwise(F.lit(0).cast("bigint"))


def minutes_seconds(seconds: Column | str) -> tuple[Column, Column]:
    s = F.floor(_col(seconds)).cast("bigint")
    return F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60))


def backoff_ms(attempt: Column | str, first: int = 1000, most: int = 8000) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), _col(attempt)))


def over_budget(total_bytes: Column, elapsed: Column, rate: float, factor: float, burst: float) -> Column:
    """Has a stream sent more than its rate allows, with a burst to spare?"""
    return total_bytes > F.lit(rate * factor) * elapsed + F.lit(burst * rate)


def pcm_to_float(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(32768.0))


def float_to_pcm(samples: Column) -> Column:
    return F.transform(samples, lambda s: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)) * 32767, 0).cast("smallint"))


def rms(samples: Column) -> Column:
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n > 0, F.sqrt(total / n)).otherwise(0.0)


def level(power: Column, muted: Column) -> Column:
    return F.when(muted, 0.0).otherwise(F.least(F.lit(1.0), power * 4))


def resample(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation at the new rate."""
    step = from_rate / to_rate
    n = F.floor(F.size(samples) / F.lit(step)).cast("int")

    def at(i: Column) -> Column:
        x = i * F.lit(step)
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, F.size(samples) - 1)
        return F.get(samples, lo) * (1 - (x - lo)) + F.get(samples, hi) * (x - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def argmax_ids(frames: Column) -> Column:
    """Per frame the place of its largest value."""
    return F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def collapse(ids: Column, blank: int = 0) -> Column:
    """Drop repeats of the raw previous value, then blanks."""
    kept = F.filter(ids, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(ids, i - 1))))
    return kept
