"""Versions of the stored tables: an ordered list of steps, applied when a table of an older version is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators.maintenance import dedup_events, normal_timestamp

#: Columns that versions add (version, table, column, type, default) and drop (version, table, column).
ADDED = [
    (2, "daily_summary", "fixture_breakdown", "string", None),
    (3, "data_retention", "auto_backup_enabled", "boolean", False),
    (3, "data_retention", "auto_backup_day_of_week", "int", 0),
    (3, "data_retention", "last_auto_backup_at", "timestamp", None),
    (5, "home_profile", "away_mode", "boolean", False),
    (5, "home_profile", "away_since", "timestamp", None),
    (5, "home_profile", "away_until", "timestamp", None),
    (5, "home_profile", "monthly_budget_litres", "double", 0.0),
    (5, "home_profile", "water_cost_per_litre", "double", 0.0),
    (5, "home_profile", "water_cost_currency", "string", "USD"),
    (5, "home_profile", "mobile_notify_targets", "string", ""),
    (6, "home_profile", "ha_presence_entities", "string", ""),
    (6, "home_profile", "ha_away_state", "string", "not_home"),
    (6, "home_profile", "ha_home_state", "string", "home"),
    (7, "events", "start_trigger", "string", "unknown"),
    (7, "events", "has_pressure_transient", "boolean", False),
    (7, "events", "flow_variability", "double", 0.0),
    (7, "events", "duration_log", "double", 0.0),
    (7, "events", "hour_sin", "double", 0.0),
    (7, "events", "hour_cos", "double", 1.0),
    (7, "events", "is_weekend", "boolean", False),
    (10, "events", "other_valve_open", "int", None),
    (11, "home_profile", "flow_unit", "string", "L/min"),
    (11, "home_profile", "pressure_unit", "string", "psi"),
    (13, "events", "match_confidence", "double", None),
    (13, "events", "match_level", "string", None),
    (13, "events", "seconds_since_prev_event", "double", None),
    (13, "events", "prev_cluster_id", "int", None),
    (13, "events", "seconds_to_next_event", "double", None),
    (13, "events", "parent_compound_id", "string", None),
    (13, "events", "compound_phase", "string", None),
    (13, "home_profile", "publish_fixtures_to_ha", "int", 1),
    (13, "fixtures", "fixture_type", "string", None),
    (13, "fixtures", "display_name", "string", None),
    (13, "fixtures", "user_locked", "int", 0),
    (13, "fixtures", "publish_to_ha", "int", 1),
    (14, "leak_test_schedule", "auto_learn_hour", "boolean", True),
    (17, "home_profile", "mqtt_publish_enabled", "int", 0),
    (18, "fixtures", "last_seen_at", "timestamp", None),
    (22, "device_config", "fw_version", "string", None),
]
DROPPED = [
    (12, "home_profile", "monthly_budget_litres"),
    (12, "home_profile", "water_cost_per_litre"),
    (12, "home_profile", "water_cost_currency"),
    (14, "home_profile", "away_until"),
    (14, "leak_test_schedule", "custom_interval_days"),
]


@dataclass(frozen=True)
class Step:
    """One change of one table; ``apply`` may be run on a table that has it already."""

    version: int
    table: str
    apply: Callable[[DataFrame], DataFrame]


def _add(column: str, kind: str, default) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows if column in rows.columns else rows.withColumn(column, F.lit(default).cast(kind))


def _drop(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.drop(column)


def shorter_retention(rows: DataFrame) -> DataFrame:
    """Both retentions at the old default of three years become one year of events and two of volumes; any other choice stays."""
    old = (F.col("events_retain_years") == 3) & (F.col("hourly_volume_retain_years") == 3)
    put = lambda c, years: F.when(old, years).otherwise(F.col(c)).cast(dict(rows.dtypes)[c])
    return rows.withColumns({"events_retain_years": put("events_retain_years", 1), "hourly_volume_retain_years": put("hourly_volume_retain_years", 2)})


def first_of_copies(events: DataFrame) -> DataFrame:
    """One event per circuit and start, that of the smallest rowid."""
    return dedup_events(events, ["circuit", "start_ts"], "rowid", newest=False)


def utc_events(events: DataFrame) -> DataFrame:
    """Text times in UTC; of events that are then one, the newest by rowid stays without its cluster; ids follow circuit and start."""
    own = events.withColumns({c: normal_timestamp(F.col(c)) for c in ("start_ts", "end_ts")})
    one = dedup_events(own, ["circuit", "start_ts"], "rowid", clear=[c for c in ("cluster_id",) if c in own.columns])
    start = F.try_to_timestamp("start_ts")
    return one.withColumn("id", F.when(start.isNotNull(), scalars.event_id(F.col("circuit"), start)).otherwise(F.col("id")))


CHANGED = [Step(1, "data_retention", shorter_retention), Step(15, "events", first_of_copies), Step(21, "events", utc_events)]
#: All steps in the order of their versions.
STEPS = sorted([*CHANGED, *(Step(v, t, _add(c, k, d)) for v, t, c, k, d in ADDED), *(Step(v, t, _drop(c)) for v, t, c in DROPPED)], key=lambda s: s.version)
LATEST = STEPS[-1].version


def migrated(rows: DataFrame, table: str, version: int, to: int = LATEST) -> DataFrame:
    """A table of one version as a later one has it: the steps of its table in between, in order. A newer version than ``to`` raises."""
    if version > to:
        raise ValueError(f"{table} is of version {version}, newer than {to}")
    for step in STEPS:
        if step.table == table and version < step.version <= to:
            rows = step.apply(rows)
    return rows
