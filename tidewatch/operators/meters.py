"""Volumes of a day and of a week from cumulative meters that may start again from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.series import running, seconds

#: Seconds after midnight within which a reading is the baseline of its day.
SEED_SECONDS = 7200


def _base(low: Column, first: Column, day: Column) -> Column:
    """The baseline after readings whose least is ``low``: the seed is the first of them if it comes in time, else zero, and a lower reading replaces it."""
    late = seconds(first) - seconds(day.cast("timestamp")) > SEED_SECONDS
    return F.when(late, F.least(low, F.lit(0.0))).otherwise(low)


def day_baselines(readings: DataFrame, key: str = "circuit", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, day, base): the baseline that each day with readings ends with.

    The state of a stretch of readings is its least value and its first time. Both merge in any order, so Spark adds them up before the shuffle.
    """
    own = readings.where(F.col(value).isNotNull()).groupBy(key, F.to_date(ts).alias("day"))
    return own.agg(F.min(value).alias("low"), F.min(ts).alias("first")).select(key, "day", _base(F.col("low"), F.col("first"), F.col("day")).alias("base"))


def day_usage(readings: DataFrame, key: str = "circuit", ts: str = "ts", value: str = "value", tie: str = "id", back: int = 7) -> DataFrame:
    """(key, day, used_day, used_week): a meter's volume over each day and since midnight ``back`` days before, as its last reading of the day shows.

    A reading under the baseline is a reset and becomes the baseline, so what flowed before a reset is lost: 100, 5, 60 gives 55. The baseline of a day is
    its first reading within two hours of midnight, else zero. That of the week is the one that its first day ended with, zero without readings on it, and
    resets of the last day lower it. Null values are no readings.
    """
    own = readings.where(F.col(value).isNotNull())
    days = own.groupBy(key, F.to_date(ts).alias("day")).agg(F.min(value).alias("low"), F.min(ts).alias("first"), F.max_by(value, F.struct(ts, tie)).alias("now"))
    week = day_baselines(readings, key, ts, value).select(key, F.date_add("day", back).alias("day"), F.col("base").alias("week_base"))
    out = days.join(week, [key, "day"], "left").withColumn("base", _base(F.col("low"), F.col("first"), F.col("day")))
    used = lambda base: F.greatest(F.lit(0.0), F.col("now") - base)
    return out.select(key, "day", used(F.col("base")).alias("used_day"), used(F.least(F.coalesce("week_base", F.lit(0.0)), "low")).alias("used_week"))


def running_usage(readings: DataFrame, key: str = "circuit", ts: str = "ts", value: str = "value", tie: str = "id", back: int = 7) -> DataFrame:
    """readings (those with a value) with used_day and used_week as they stand at each of them; otherwise as day_usage()."""
    own = readings.where(F.col(value).isNotNull()).withColumn("__day", F.to_date(ts))
    own = own.withColumn("__period", F.struct(F.col(key).alias("k"), F.col("__day").alias("d")))
    own = running(own, "__period", [ts, tie], {"__low": ("min", F.col(value)), "__first": ("min", F.col(ts))})
    week = day_baselines(readings, key, ts, value).select(F.col(key).alias("__key"), F.date_add("day", back).alias("__then"), F.col("base").alias("__week"))
    out = own.join(week, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__day") == F.col("__then")), "left")
    used = lambda base: F.greatest(F.lit(0.0), F.col(value) - base)
    out = out.withColumns({"used_day": used(_base(F.col("__low"), F.col("__first"), F.col("__day"))), "used_week": used(F.least(F.coalesce("__week", F.lit(0.0)), "__low"))})
    return out.drop("__day", "__period", "__low", "__first", "__key", "__then", "__week")
