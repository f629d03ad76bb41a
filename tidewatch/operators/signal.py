"""Signal conditioning and run timers over sensor series, one row per reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.series import framed, islands, numbered, previous, running, seconds


def block_sum(values: Column, first: Column, size: int, block: int = 16) -> Column:
    """The sum of an array of ``size`` values whose first has the place ``first`` (from 0) in its series: the values up to a multiple of ``block`` one by one,
    then whole blocks, each summed by itself, then the rest one by one.

    Sums of decimals differ in their last bits by their order, which decides comparisons with a limit that the exact sum meets; this order is that of the SQL.
    """
    plus = lambda part, start: F.aggregate(part, start, lambda s, x: s + x)
    head = F.pmod(-first, F.lit(block)).cast("int")
    whole = F.greatest(F.floor((size - head) / block), F.lit(0)).cast("int")
    total = plus(F.slice(values, F.lit(1), head), F.lit(0.0))
    for i in range(size // block):
        total = total + F.when(i < whole, plus(F.slice(values, head + i * block + 1, F.lit(block)), F.lit(0.0))).otherwise(0.0)
    return plus(F.slice(values, head + whole * block + 1, F.lit(block)), total)


def lagged_baseline(df: DataFrame, key: str, order: list[str], value: str, lookback: int = 120, window: int = 80, threshold: float = 2.0) -> DataFrame:
    """df with baseline, the mean of the ``window`` samples ``lookback`` behind (null until all are there), drop and is_drop."""
    back = lookback + window - 1
    own = framed(df, key, order, {"__all": ("list", F.col(value).cast("double"), -back, -lookback)})
    based = own.withColumn("baseline", F.when(F.size("__all") == window, block_sum(F.col("__all"), F.col("pos") - 1 - back, window) / window))
    drop = F.col("baseline") - F.col(value)
    return based.withColumns({"drop": drop, "is_drop": F.coalesce(drop >= threshold, F.lit(False))}).drop("__all", "pos")


def composite_drop(df: DataFrame, key: str, order: list[str], value: str, threshold: float = 2.0, factor: float = 1.5) -> DataFrame:
    """df with is_composite: the mean of samples 3 to 7 behind exceeds this one by factor * threshold, from the eighth sample on."""
    own = framed(df, key, order, {"__n": ("count", value, -7, -3), "__avg": ("avg", value, -7, -3)})
    return own.withColumn("is_composite", (F.col("__n") == 5) & (F.col("__avg") - F.col(value) >= factor * threshold)).drop("__n", "__avg", "pos")


def moving_average(df: DataFrame, key: str, order: list[str], value: str, window: int, every: int) -> DataFrame:
    """Every ``every``-th row with the mean of the last ``window`` samples (fewer at the start)."""
    own = framed(df, key, order, {"moving_avg": ("avg", value, -(window - 1), 0)})
    return own.where(F.col("pos") % every == 0).drop("pos")


def rapid_drop(df: DataFrame, key: str, order: list[str], value: str, valid: Column, back: int = 10, threshold: float = 10.0, grace_seconds: float = 30.0) -> DataFrame:
    """df with is_rapid: more than threshold below the sample ``back`` rows before it in the same valid run, the grace after the first row over.

    An invalid row empties the buffer: samples before it are not compared with those after it.
    """
    own = df.withColumn("__ok", F.coalesce(valid, F.lit(False)))
    own = running(own, key, order, {"__run": ("sum", F.when(F.col("__ok"), 0).otherwise(1).cast("long")), "pos": ("sum", F.lit(1).cast("long")), "__t0": ("max", -seconds(F.col(order[0])))})
    start = framed(own, key, order, {"__old": ("first", F.struct(F.col(value).alias("v"), F.col("__run").alias("r"), F.col("__ok").alias("ok")), -back, 0), "__n": ("count", F.lit(1), -back, 0)}, placed=True)
    enough = (F.col("__n") == back + 1) & F.col("__ok") & F.col("__old.ok") & (F.col("__old.r") == F.col("__run"))
    calm = seconds(F.col(order[0])) + F.col("__t0") >= grace_seconds
    return start.withColumn("is_rapid", F.coalesce(enough & calm & (F.col("__old.v") - F.col(value) > threshold), F.lit(False))).drop("__ok", "__run", "__old", "__n", "__t0", "pos")


def debounced(df: DataFrame, key: str, order: list[str], on: Column, hold_seconds: float = 8.0) -> DataFrame:
    """(key, on_ts, off_ts, pulses): on from the first pulse until hold_seconds after the last one that follows within that time."""
    pulses = previous(df.where(on), key, order, {"__t": order[0]})
    opens = F.col("__t").isNull() | (seconds(F.col(order[0])) - seconds(F.col("__t")) > hold_seconds)
    runs = islands(pulses, key, order, opens, "__run").groupBy(key, "__run")
    hold = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hold_seconds))
    return runs.agg(F.min(order[0]).alias("on_ts"), (F.max(order[0]) + hold).alias("off_ts"), F.count("*").alias("pulses")).drop("__run")


def runs(df: DataFrame, key: str, order: list[str], inside: Column) -> DataFrame:
    """df with run (a number shared by consecutive rows inside), pos and in_run; a row outside ends the run before it."""
    own = df.withColumn("in_run", F.coalesce(inside, F.lit(False)))
    return running(own, key, order, {"run": ("sum", F.when(F.col("in_run"), 0).otherwise(1).cast("long")), "pos": ("sum", F.lit(1).cast("long"))})


def run_alerts(df: DataFrame, key: str, order: list[str], inside: Column, samples: int) -> DataFrame:
    """(key, started_at, alert_at): for each run of at least ``samples`` consecutive rows inside, its first and its ``samples``-th row."""
    own = runs(df, key, order, inside).where("in_run")
    grouped = own.groupBy(key, "run").agg(F.min("pos").alias("__first"), F.min(order[0]).alias("started_at"), F.count("*").alias("__n")).where(F.col("__n") >= samples)
    at = own.select(F.col(key), (F.col("pos") - samples + 1).alias("__first"), F.col(order[0]).alias("alert_at"))
    return grouped.join(at, [key, "__first"]).select(key, "started_at", "alert_at")


def sustained_runs(df: DataFrame, key: str, order: list[str], inside: Column, least_seconds: float = 2.0) -> DataFrame:
    """(key, started_at, ended_at, n): runs of rows inside that span at least least_seconds; a run starts at its first reading."""
    own = runs(df, key, order, inside).where("in_run").groupBy(key, "run")
    out = own.agg(F.min(order[0]).alias("started_at"), F.max(order[0]).alias("ended_at"), F.count("*").alias("n"))
    return out.where(seconds(F.col("ended_at")) - seconds(F.col("started_at")) >= least_seconds).drop("run")


def integrated(df: DataFrame, key: str, order: list[str], flow: str, group: list[str], most_seconds: float = 1e9) -> DataFrame:
    """Litres per group from flow in litres a minute: each interval between two readings times their mean (trapezium)."""
    own = previous(df, key, order, {"__t": order[0], "__f": flow})
    dt = seconds(F.col(order[0])) - seconds(F.col("__t"))
    return own.groupBy(*group).agg(F.coalesce(F.sum(F.when(dt <= most_seconds, (F.col(flow) + F.col("__f")) / 2 * dt / 60)), F.lit(0.0)).alias("litres"))


def thinned(df: DataFrame, key: str, order: list[str], started: str, after_seconds: float = 120.0, every: int = 5) -> DataFrame:
    """All readings of the first after_seconds of an event, then every ``every``-th."""
    own = numbered(df, key, order, "__p")
    early = seconds(F.col(order[0])) - seconds(F.col(started)) <= after_seconds
    return own.where(early | (F.col("__p") % every == 0)).drop("__p")


def latched(df: DataFrame, key: str, order: list[str], trigger: Column, reset: Column) -> DataFrame:
    """df with fault: a trigger since the last reset (a reset row itself has none unless it triggers)."""
    own = df.withColumns({"__on": F.coalesce(trigger, F.lit(False)), "__off": F.coalesce(reset, F.lit(False))})
    mark = F.when(F.col("__on"), F.lit(True)).when(F.col("__off"), F.lit(False))
    return running(own, key, order, {"fault": ("last", mark)}).withColumn("fault", F.coalesce("fault", F.lit(False))).drop("__on", "__off")


def edges(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The rows where a state differs from the one before it, with that one as before."""
    own = previous(df, key, order, {"before": state})
    return own.where(~F.col("before").eqNullSafe(F.col(state)))


def placed_in_group(df: DataFrame, group: list[str], order: list[str], prefix: str = "__") -> DataFrame:
    """df with {prefix}p, the place of each row in its group from 1, and {prefix}n, the size of the group; no task holds a group."""
    own = numbered(df.withColumn(f"{prefix}g", F.struct(*group)), f"{prefix}g", order, f"{prefix}p")
    sizes = own.groupBy(F.col(f"{prefix}g").alias(f"{prefix}k")).agg(F.count("*").alias(f"{prefix}n"))
    return own.join(sizes, F.col(f"{prefix}g") == F.col(f"{prefix}k")).drop(f"{prefix}g", f"{prefix}k")


def last_ema(df: DataFrame, group: list[str], order: list[str], value: str, alpha: float = 0.2) -> DataFrame:
    """(group, last_ema): the exponential average after the last value of each group, as a sum of weighted values (groups without null keys).

    Null values are no readings: they neither count nor age the others, and a group of only nulls has no row.
    """
    own = placed_in_group(df.where(F.col(value).isNotNull()), group, order)
    age = F.col("__n") - F.col("__p")
    weight = F.when(F.col("__p") == 1, F.pow(F.lit(1 - alpha), age)).otherwise(alpha * F.pow(F.lit(1 - alpha), age))
    return own.groupBy(*group).agg(F.sum(weight * F.col(value)).alias("last_ema"))


def curve_shapes(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """(group, shape): curves.curve_shape of each group's values in order, from places instead of arrays, so a long group costs no task its memory."""
    own = placed_in_group(df, group, order)
    n, place = F.col("__n"), F.col("__p")
    cut = F.greatest(F.lit(1), F.floor(n / 5).cast("long"))
    m = n - 2 * cut
    third = F.greatest(F.lit(1), F.floor(m / 3).cast("long"))
    at = place - cut
    inside = (at >= 1) & (at <= m)
    x = F.col(value)
    stats = own.groupBy(*group).agg(F.first(n).alias("n"), F.first(m).alias("m"), F.avg(F.when(inside, x)).alias("mean"), F.stddev_samp(F.when(inside, x)).alias("dev"), F.avg(F.when(inside & (at <= third), x)).alias("head"), F.avg(F.when(inside & (at > m - third), x)).alias("tail"))
    unknown = F.coalesce((F.col("n") < 10) | (F.col("m") < 6) | (F.col("mean") <= 0), F.lit(True))
    change = (F.col("tail") - F.col("head")) / F.col("mean")
    shape = F.when(unknown, "unknown").when(F.coalesce("dev", F.lit(0.0)) / F.col("mean") >= 0.55, "pulsed").when(change > 0.15, "rising").when(change < -0.15, "falling").otherwise("steady")
    return stats.select(*group, shape.alias("shape"))


def resampled(df: DataFrame, group: list[str], order: list[str], value: str, bins: int) -> DataFrame:
    """(group, bin, mean): each group's values in order, in at most ``bins`` bins as in curves.resample (one a value if there are fewer)."""
    own = placed_in_group(df, group, order)
    k = F.least(F.lit(bins), F.col("__n"))
    low = lambda i: F.bround(i * F.col("__n") / k).cast("long")
    at = F.col("__p") - 1
    here = [F.when((at >= low(F.lit(i))) & (at < F.greatest(low(F.lit(i + 1)), low(F.lit(i)) + 1)), F.lit(i)) for i in range(bins)]
    return own.withColumn("bin", F.coalesce(*here)).groupBy(*group, "bin").agg(F.avg(value).alias("mean"))
