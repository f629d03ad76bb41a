"""Usage events from a history of readings: runs of flow and of an onset signal, merged, checked and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import curves, scalars
from tidewatch.operators.intervals import coalesce_intervals, near, range_join
from tidewatch.operators.series import previous, seconds
from tidewatch.operators.signal import runs
from tidewatch.sources.history import kept

#: Added before rounding: a mean of decimals often lies between two roundings.
NUDGE = 1e-9


def flow_periods(readings: DataFrame, window_end=None, least_flow: float = 0.05) -> DataFrame:
    """(circuit, start_ts, end_ts): runs of flow readings of at least least_flow and of onset readings that are on, each kind by itself.

    A run goes from its first reading to the one that ends it. One that nothing ends goes to window_end, without one to its last reading, if that is
    later than its first. Flow text that is no number is 0; states are on, true or 1, whatever their case. Both kinds are one pass.
    """
    flow = scalars.number(F.col("state"), 0.0) >= least_flow
    inside = F.when(F.col("role") == "flow", flow).otherwise(F.lower("state").isin("on", "true", "1"))
    own = readings.where("role in ('flow', 'onset')").select("circuit", "id", "ts", F.struct("circuit", "role").alias("series"), inside.alias("inside"))
    found = runs(own, "series", ["ts", "id"], F.col("inside"))
    of = F.when(F.col("in_run"), F.col("run")).otherwise(F.col("run") - 1)  # the reading that ends a run belongs to it
    ends = found.groupBy("series", of.alias("of")).agg(F.min(F.when(F.col("in_run"), F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("in_run"), F.col("ts"))).alias("last"), F.min(F.when(~F.col("in_run"), F.col("ts"))).alias("off"))
    until = F.col("last") if window_end is None else F.lit(window_end).cast(dict(readings.dtypes)["ts"])
    closed = ends.where("start_ts is not null").where(F.col("off").isNotNull() | (until > F.col("start_ts")))
    return closed.select("series.circuit", "start_ts", F.coalesce("off", until).alias("end_ts"))


def reconstructed_events(
    readings: DataFrame, stored: DataFrame, window_end=None, gap_seconds: float = 15.0, min_seconds: float = 3.0, near_seconds: float = 30.0, pre_seconds: float = 30.0, least_flow: float = 0.05, least_drop: float = 0.8, averaged: bool = False
) -> DataFrame:
    """Events of a history that are not stored yet, with flow and pressure measured over the readings of each.

    readings: (circuit, id, ts, role, state) with roles flow, onset, pressure and volume. Periods at most gap_seconds apart are one; those under
    min_seconds, those that start within near_seconds of a stored event of the circuit, and those without a flow of least_flow are left out. The
    baseline is the mean pressure of the pre_seconds before the start, else of the first three readings since, else 0. A transient is a drop from it of
    least_drop, or three tenths of that where the pressure is an averaged one. The meter's first and last value give the volume if they lie over 0
    and under 10,000 apart. Events start by flow.

    Readings are measured by event and five minutes first, so that a long event is no single group of all its readings.
    """
    periods = kept(flow_periods(readings, window_end, least_flow).distinct().withColumn("tie", F.xxhash64("circuit", "start_ts", "end_ts")), "periods")
    merged = coalesce_intervals(periods, "circuit", "start_ts", "end_ts", "tie", gap_seconds, min_seconds)
    fresh = near(merged, stored, "circuit", "start_ts", near_seconds, anti=True)
    points = readings.where("role in ('flow', 'pressure', 'volume')").select("circuit", "id", "ts", "role", scalars.number(F.col("state")).alias("value")).where("value is not null")
    joined = range_join(fresh, points, "circuit", "start_ts", "end_ts", "ts", pre_seconds)
    inside, role, place = F.col("point.ts") >= F.col("start_ts"), F.col("point.role"), F.struct("point.ts", "point.id", "point.value")
    flow, pressure = scalars.clean_flow(F.col("point.value")), scalars.clean_pressure(F.col("point.value"))
    is_flow, is_pressure, is_before = (role == "flow") & inside, (role == "pressure") & inside, (role == "pressure") & (F.col("point.ts") <= F.col("start_ts"))
    meter = F.when((role == "volume") & inside & ~F.isnan("point.value") & (F.abs("point.value") < float("inf")), place)
    three = lambda found: F.slice(F.array_sort(found), 1, 3)
    event = ["circuit", "start_ts", "end_ts"]
    parts = joined.groupBy(*event, F.floor(seconds(F.col("point.ts")) / 300).alias("part")).agg(
        F.sum(F.when(is_flow, flow)).alias("flow"), F.max(F.when(is_flow, flow)).alias("peak"), F.count(F.when(is_flow, 1)).alias("n_flow"),
        F.sum(F.when(is_before, pressure)).alias("before"), F.count(F.when(is_before, 1)).alias("n_before"), F.min(F.when(is_pressure, pressure)).alias("low"),
        three(F.collect_list(F.when(is_pressure, F.struct("point.ts", "point.id", pressure.alias("value"))))).alias("three"), F.min(meter).alias("m0"), F.max(meter).alias("m1"), F.count(meter).alias("n_meter"),
    )
    whole = parts.groupBy(*event).agg(
        (F.sum("flow") / F.sum("n_flow")).alias("avg_flow_lpm"), F.max("peak").alias("peak_flow_lpm"), F.sum("n_flow").alias("n_flow"), (F.sum("before") / F.sum("n_before")).alias("before"), F.min("low").alias("low"),
        three(F.flatten(F.collect_list("three"))).alias("three"), (F.max("m1")["value"] - F.min("m0")["value"]).alias("metered"), F.sum("n_meter").alias("n_meter"),
    )
    first = F.aggregate("three", F.lit(0.0), lambda s, x: s + x["value"]) / F.size("three")
    base = F.coalesce("before", F.when(F.size("three") > 0, first), F.lit(0.0))
    out = whole.where(F.col("peak_flow_lpm") >= least_flow).withColumns({"base": base, "least": F.coalesce("low", base)})
    drop = F.greatest(F.lit(0.0), F.col("base") - F.col("least"))
    ok = (F.col("n_meter") >= 2) & (F.col("metered") > 0) & (F.col("metered") < 10000)
    return out.select(
        *event, F.lit("flow").alias("start_trigger"), (F.col("low").isNotNull() & (drop >= least_drop * (0.3 if averaged else 1.0))).alias("has_pressure_transient"), F.round(F.col("base") + NUDGE, 2).alias("pre_event_pressure_psi"),
        F.round(F.col("least") + NUDGE, 2).alias("min_pressure_psi"), F.round(drop + NUDGE, 2).alias("pressure_delta_psi"), "avg_flow_lpm", "peak_flow_lpm", "n_flow", F.when(ok, F.round(F.col("metered") + NUDGE, 3)).alias("volume_litres_measured"),
    )


def event_features(events: DataFrame) -> DataFrame:
    """The derived columns of an event row from a raw event (with the arrays flow_readings and pressure_readings)."""
    duration = seconds(F.col("end_ts")) - seconds(F.col("start_ts"))
    flow = curves.array_stats(F.col("flow_readings"))
    sin, cos = scalars.hour_circle(F.hour("start_ts"))
    avg_flow = F.coalesce(flow["mean"], F.lit(0.0))
    delta = F.greatest(F.col("pre_event_pressure_psi") - F.col("min_pressure_psi"), F.lit(0.0))
    weekday = F.weekday("start_ts")
    return events.select(
        scalars.event_id(F.col("circuit"), F.col("start_ts")).alias("id"),
        "circuit", "start_ts", "end_ts",
        duration.alias("duration_seconds"),
        F.round(avg_flow, 4).alias("avg_flow_lpm"),
        F.round(F.coalesce(flow["max"], F.lit(0.0)), 4).alias("peak_flow_lpm"),
        F.round(flow["stdev"], 4).alias("flow_variability"),
        F.round(delta, 4).alias("pressure_delta_psi"),
        "pre_event_pressure_psi", "min_pressure_psi",
        F.round(scalars.resistance(avg_flow, delta, F.col("has_pressure_transient")), 4).alias("hydraulic_resistance"),
        curves.curve_shape(F.when(F.size("flow_readings") > 0, curves.resample(F.col("pressure_readings"), F.size("flow_readings")))).alias("resistance_curve_shape"),
        F.round(scalars.volume(F.col("volume_litres_measured"), avg_flow, duration), 4).alias("volume_litres"),
        "start_trigger", "has_pressure_transient", "is_composite",
        F.round(F.log1p(duration), 4).alias("duration_log"),
        F.hour("start_ts").alias("hour_of_day"), weekday.alias("day_of_week"),
        F.round(sin, 4).alias("hour_sin"), F.round(cos, 4).alias("hour_cos"), (weekday >= 5).alias("is_weekend"),
    )


def with_gaps(events: DataFrame, within_seconds: float = 300.0) -> DataFrame:
    """events with the seconds to the next event of the circuit (by start), if under within_seconds."""
    later = previous(events.withColumn("__back", F.timestamp_micros((-1_000_000 * seconds(F.col("start_ts"))).cast("long"))), "circuit", ["__back", "id"], {"__next": "start_ts"})
    gap = seconds(F.col("__next")) - seconds(F.col("end_ts"))
    return later.withColumn("seconds_to_next_event", F.when((gap >= 0) & (gap < within_seconds), gap)).drop("__back", "__next")
