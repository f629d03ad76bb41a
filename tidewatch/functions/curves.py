"""Features of the two sample arrays of an event, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def finite(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))


def array_stats(a: Column) -> dict[str, Column]:
    """Mean, maximum and sample deviation (0 for fewer than two) of the finite values."""
    own = finite(a)
    mean = _mean(own)
    squares = F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return {"mean": mean, "max": F.array_max(own), "stdev": F.when(F.size(own) < 2, 0.0).otherwise(F.sqrt(squares / (F.size(own) - 1)))}


def resample(a: Column, n: Column) -> Column:
    """n bins of the array: bin i is the mean of [round(i s), max(round((i + 1) s), that + 1)), s = size / n, halves to even."""
    step = F.size(a) / n
    low = lambda i: F.bround(i * step).cast("int")
    size = lambda i: F.greatest(F.bround((i + 1) * step).cast("int"), low(i) + 1) - low(i)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: _mean(F.slice(a, low(i) + 1, size(i))))).otherwise(F.array().cast("array<double>"))


def curve_shape(a: Column) -> Column:
    """unknown, pulsed, rising, falling or steady.

    A fifth is cut from both ends; unknown with fewer than 10 samples, 6 usable ones or a mean of at most 0; pulsed if the relative deviation is at
    least 0.55; rising or falling if the last third's mean differs from the first's by over 15 % of the mean.
    """
    cut = F.greatest(F.lit(1), F.floor(F.size(a) / 5).cast("int"))
    usable = F.when(F.size(a) >= 10, F.slice(a, cut + 1, F.size(a) - 2 * cut))
    mean = _mean(usable)
    third = F.greatest(F.lit(1), F.floor(F.size(usable) / 3).cast("int"))
    change = (_mean(F.slice(usable, F.size(usable) - third + 1, third)) - _mean(F.slice(usable, F.lit(1), third))) / mean
    spread = array_stats(usable)["stdev"] / mean
    unknown = F.coalesce((F.size(a) < 10) | (F.size(usable) < 6) | (mean <= 0), F.lit(True))
    return F.when(unknown, "unknown").when(spread >= 0.55, "pulsed").when(change > 0.15, "rising").when(change < -0.15, "falling").otherwise("steady")


def last_ema(a: Column, alpha: float = 0.2) -> Column:
    """The exponential average of an ordered array after its last value; the first value starts it, an empty array has none."""
    return F.aggregate(a, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))
