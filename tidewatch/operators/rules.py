"""State machines and schedules as expressions over state rows: training, leak tests, faults, presence and next runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import nth_weekday
from tidewatch.operators.series import previous, running, seconds
from tidewatch.sources.history import kept

#: What a sensitivity preset stands for (pressure drop in PSI, least seconds of an event, score to alert, score to shut off).
PRESETS = {"low": (3.0, 5.0, 0.80, 0.95), "medium": (2.0, 3.0, 0.60, 0.80), "high": (1.0, 2.0, 0.40, 0.65)}
#: Codes of a leak test's end.
LEAK_RESULTS = {"passed": 2, "failed": 3, "pressure_rose": 4, "stopped": 5, "closed": 6, "fault": 7, "rapid_drop": 9}


def sensitivity(rows: DataFrame, preset: str = "preset") -> DataFrame:
    """rows with effective_<field>: the row's own value if it has one (0.0 too), else that of its preset, else of medium."""
    out = rows
    for i, field in enumerate(("pressure_drop", "min_duration", "score_alert", "score_shutoff")):
        default = F.lit(PRESETS["medium"][i])
        for name, values in PRESETS.items():
            default = F.when(F.col(preset) == name, values[i]).otherwise(default)
        out = out.withColumn(f"effective_{field}", F.coalesce(F.col(field), default))
    return out


def training_step(states: DataFrame, counts: DataFrame, as_of: Column, label_days: int = 7) -> DataFrame:
    """states with next_state at as_of: calibration ends when its time is over and enough events are there; labelling after whole days."""
    own = states.join(counts, "circuit", "left").withColumn("events_collected", F.coalesce("collected", F.lit(0)).cast("long")).drop("collected")
    ready = (as_of >= F.col("calibration_ends_at")) & (F.col("events_collected") >= F.col("minimum_events"))
    labelled = F.floor((seconds(as_of) - seconds(F.col("completed_at"))) / 86400) >= label_days
    paused = F.coalesce(F.col("paused"), F.lit(False))
    state = F.when((F.col("state") == "calibrating") & ready & ~paused, "labelling").when((F.col("state") == "labelling") & labelled, "live").otherwise(F.col("state"))
    return own.withColumn("next_state", state)


def training_progress(states: DataFrame, as_of: Column) -> DataFrame:
    """states with percent_complete (0 to 100, whole) and hours_remaining."""
    total = seconds(F.col("calibration_ends_at")) - seconds(F.col("started_at"))
    gone = seconds(as_of) - seconds(F.col("started_at"))
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(gone / F.greatest(total, F.lit(1.0)) * 100)))
    return states.withColumns({"percent_complete": percent.cast("long"), "hours_remaining": F.floor(F.greatest(F.lit(0.0), total - gone) / 3600).cast("long")})


def leak_tests(samples: DataFrame, threshold: float = 3.0, rapid: float = 10.0, back: int = 10) -> DataFrame:
    """(test_id, result, ended_at): the end of each test, from samples (test_id, ts, pressure, baseline, duration_seconds, started_at, command).

    The first sample of a test that meets a condition ends it; of several at one sample: a command, a rise over threshold, a rapid drop,
    a drop over threshold, the time. Tests without an end have none.
    """
    drop = F.col("baseline") - F.col("pressure")
    command = F.when(F.col("command") == "stop", LEAK_RESULTS["stopped"]).when(F.col("command") == "closed", LEAK_RESULTS["closed"]).when(F.col("command") == "fault", LEAK_RESULTS["fault"])
    over = seconds(F.col("ts")) - seconds(F.col("started_at")) >= F.col("duration_seconds")
    result = F.coalesce(
        command,
        F.when(-drop > threshold, LEAK_RESULTS["pressure_rose"]).when(F.col("rapid_drop_psi") > rapid, LEAK_RESULTS["rapid_drop"]).when(drop > threshold, LEAK_RESULTS["failed"]).when(over, LEAK_RESULTS["passed"]),
    )
    return samples.withColumn("__r", result).where("__r is not null").groupBy("test_id").agg(F.min_by("__r", "ts").alias("result"), F.min("ts").alias("ended_at"))


def faults(readings: DataFrame, burst: float = 25.0, rapid: float = 10.0) -> DataFrame:
    """readings with fault_kind: a burst on the raw flow (1.5 times the limit), on the smoothed flow, or a rapid drop while water flows."""
    kind = F.when(F.col("raw_flow") > 1.5 * burst, "instant_burst").when(F.col("flow") > burst, "burst").when((F.col("drop_5s") > rapid) & (F.col("flow") > 0), "rapid_drop")
    return readings.withColumn("fault_kind", kind)


def valve_state(open_stop: Column, closed_stop: Column) -> Column:
    return F.when(open_stop & ~closed_stop, "open").when(closed_stop & ~open_stop, "closed").otherwise("unknown")


def presence(states: DataFrame, home: str = "home", away: str = "not_home", key: str = "circuit") -> DataFrame:
    """(key, away): true if all known persons are away, false if one is home, null if neither or none is known. Null and empty states are not known."""
    known = F.when(F.col("state") != "", F.col("state"))
    all_away, any_home = F.bool_and(known == away), F.bool_or(known == home)
    return states.groupBy(key).agg(F.when(all_away, True).when(any_home, False).alias("away"))


def away_history(states: DataFrame, key: str, entity: str, entities: list[str], order: list[str], home: str = "home", away: str = "not_home") -> DataFrame:
    """states with ``away``, the mode after each change, and ``toggled``, whether it changed it: set when all known entities are away, cleared when one is home.

    entities is the short list of those that count; one that has said nothing yet is not known, an empty or null state says nothing. All are carried in one
    pass and the mode in a second one.
    """
    counts = F.col(entity).isin(entities) & (F.col("state") != "")
    own = running(states, key, order, {f"__e{i}": ("last", F.when(counts & (F.col(entity) == e), F.col("state"))) for i, e in enumerate(entities)})
    now = F.array(*[F.col(f"__e{i}") for i in range(len(entities))])
    known = F.filter(now, lambda s: s.isNotNull())
    all_away, any_home = (F.size(known) > 0) & F.forall(known, lambda s: s == away), F.exists(known, lambda s: s == home)
    marked = kept(own.withColumn("__mode", F.when(counts & all_away, True).when(counts & any_home, False)).drop(*[f"__e{i}" for i in range(len(entities))]), "presence")
    out = running(marked, key, order, {"away": ("last", F.col("__mode"))})
    before = previous(kept(out.withColumn("away", F.coalesce("away", F.lit(False))).drop("__mode"), "presence"), key, order, {"__was": "away"})
    return before.withColumn("toggled", F.col("away") != F.coalesce("__was", F.lit(False))).drop("__was")


def next_run(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows with next_run, the first time after as_of of a schedule (frequency, hour, weekday, last_run).

    daily, weekly and fortnightly (two weeks after the last run, if that is known) go by day; monthly is the first such weekday of a month. Unknown
    frequencies give null.
    """
    at = lambda day: (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"), F.lit(0), F.lit(0)))
    today = F.to_date(as_of)
    daily = F.when(at(today) > as_of, at(today)).otherwise(at(F.date_add(today, 1)))
    ahead = F.pmod(F.col("weekday") - F.weekday(today), F.lit(7))
    this_week = F.date_add(today, ahead.cast("int"))
    weekly = F.when(at(this_week) > as_of, at(this_week)).otherwise(at(F.date_add(this_week, 7)))
    after = F.date_add(F.to_date("last_run"), 14)
    fortnightly = F.when(F.col("last_run").isNotNull() & (at(after) > as_of), at(after)).otherwise(weekly)
    first = lambda m: F.coalesce(*[F.when(F.col("weekday") == d, nth_weekday(m, d, 1)) for d in range(7)])
    month, following = F.trunc(today, "month"), F.add_months(F.trunc(today, "month"), 1)
    monthly = F.when(at(first(month)) > as_of, at(first(month))).otherwise(at(first(following)))
    kind = F.col("frequency")
    return rows.withColumn("next_run", F.when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "fortnightly", fortnightly).when(kind == "monthly", monthly))


def alerts(rows: DataFrame, config: DataFrame) -> DataFrame:
    """rows (circuit, alert_type, critical) that are to be sent: critical ones, and those not switched off."""
    own = rows.join(config.select("circuit", "alert_type", "enabled"), ["circuit", "alert_type"], "left")
    return own.where(F.col("critical") | F.coalesce("enabled", F.lit(True))).drop("enabled")


def minutes_remaining(ends_at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((seconds(ends_at) - seconds(as_of)) / 60)).cast("long")


def extended_window(started_at: Column, ends_at: Column, minutes: int, most_minutes: int = 60) -> Column:
    """A later end of a window, at most most_minutes after its start."""
    more = lambda c, m: c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m), F.lit(0))
    return F.least(more(ends_at, minutes), more(started_at, most_minutes))


def calibration_end(ends: DataFrame, away: DataFrame, most_days: int = 90) -> DataFrame:
    """ends with calibration_ends_at later by the time away: spans of over 0 and under most_days count."""
    span = seconds(F.col("until")) - seconds(F.col("since"))
    own = away.groupBy("circuit").agg(F.sum(F.when((span > 0) & (span < most_days * 86400), span)).alias("__away"))
    later = F.col("calibration_ends_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("__away", F.lit(0.0)))
    return ends.join(own, "circuit", "left").withColumn("calibration_ends_at", later).drop("__away")
