"""Set-up, training and test upkeep: resets, write-backs, catch-up ranges, merges with counts, test results and alert texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.intervals import in_interval
from tidewatch.operators.maintenance import insert_missing
from tidewatch.operators.series import seconds

#: The types of fixture, by place, and their labels; the last of all but one is kept for generated events.
FIXTURE_TYPES = {
    "toilet": "Toilet",
    "shower": "Shower",
    "bath": "Bath",
    "bathroom_tap": "Bathroom tap",
    "bidet": "Bidet",
    "kitchen_tap": "Kitchen tap",
    "dishwasher": "Dishwasher",
    "ice_maker": "Ice maker",
    "refrigerator_water": "Refrigerator water",
    "ro_drinking_faucet": "RO drinking faucet",
    "washing_machine": "Washing machine",
    "utility_tap": "Utility tap",
    "hose_bib": "Hose bib",
    "outdoor_tap": "Outdoor tap",
    "irrigation_zone": "Irrigation zone",
    "pool_fill": "Pool fill",
    "humidifier": "Humidifier",
    "water_softener": "Water softener",
    "ro_system_whole_house": "RO system (whole-house)",
    "evaporative_cooler": "Evaporative cooler",
    "boiler_makeup": "Boiler make-up",
    "leak_test": "Leak test (auto)",
    "other": "Other",
}
INTERNAL_TYPES = ("leak_test",)
#: What a finished test reports.
TEST_RESULTS = (
    "Passed — no leak detected",
    "Failed — leak detected",
    "Aborted — external pressure influence",
    "Stopped manually",
    "Not run — valve was closed (open valve first)",
    "Not run — fault active (reset fault first)",
    "Aborted — demand detected (sudden pressure drop)",
)
TIMED_OUT = "Timed out — no terminal result received"
#: Role of an entity -> (what its name says, its domain); {c} stands for the circuit's name.
ROLE_NAMES = {
    "flow_sensor": ("water flow rate.*{c}", "sensor"),
    "pressure_fast_sensor": ("water pressure.*{c}.*fast", "sensor"),
    "pressure_avg_sensor": ("water pressure.*{c}.*averaged", "sensor"),
    "pressure_history_sensor": (r"water pressure.*{c}(?!\s*\((?:fast|averaged))", "sensor"),
    "flow_onset_sensor": ("flow pulse onset.*{c}", "binary_sensor"),
    "valve_entity": ("{c} water valve", "valve"),
    "fault_sensor": ("safety fault.*{c}", "binary_sensor"),
    "fault_reason_sensor": ("fault reason.*{c}|safety fault.*reason.*{c}", "sensor"),
    "trickle_sensor": ("trickle.*alert.*{c}", "binary_sensor"),
    "leak_test_sensor": ("leak test active.*{c}", "binary_sensor"),
    "leak_test_switch": ("micro leak test.*{c}", "switch"),
    "leak_test_result_sensor": ("leak test result.*{c}", "sensor"),
    "leak_test_duration_sensor": ("leak test duration.*{c}", "number"),
    "volume_sensor": ("water volume total.*{c}", "sensor"),
}
CIRCUITS = ("main", "irrigation")


def role_patterns(circuits: tuple[str, ...] = CIRCUITS) -> dict[str, tuple[str, str]]:
    """``circuit.role`` -> (domain, pattern) for match_roles: all roles of each circuit."""
    return {f"{c}.{role}": (domain, name.format(c=c) if "(?!" not in name else name.replace("{c}", c)) for c in circuits for role, (name, domain) in ROLE_NAMES.items()}


def unmatched_required(matches: DataFrame) -> DataFrame:
    """(circuit, all_matched, unmatched) from matches(circuit, role, matched, optional): the required roles without an entity, by name."""
    gap = ~F.col("matched") & ~F.col("optional")
    return matches.groupBy("circuit").agg((~F.bool_or(gap)).alias("all_matched"), F.array_join(F.sort_array(F.collect_set(F.when(gap, F.col("role")))), ",").alias("unmatched"))


def excluded_from_training(events: DataFrame, windows: DataFrame, composite: str = "is_composite") -> DataFrame:
    """events with excluded_from_training: composite ones, and those that start in a window of their circuit (both ends included).

    windows may overlap: they are first brought to the events as a semi-join on (circuit, time bucket), so an event stays one row.
    """
    hit = in_interval(events.select("id", "circuit", "start_ts"), windows, "circuit", "start_ts", "started_at", "ends_at").select("id").distinct().withColumn("__hit", F.lit(True))
    flag = F.coalesce(F.col(composite), F.lit(False)) | F.coalesce("__hit", F.lit(False))
    return events.join(hit, "id", "left").withColumn("excluded_from_training", flag).drop("__hit")


def without_circuits(tables: Mapping[str, DataFrame], circuits: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of some circuits: what a full recalibration leaves."""
    gone = circuits.select("circuit").distinct()
    return {name: rows.join(gone, "circuit", "left_anti") for name, rows in tables.items()}


def without_unconfirmed(clusters: DataFrame, started: DataFrame) -> DataFrame:
    """clusters without those of the started circuits that belong to no fixture."""
    fresh = started.select("circuit").distinct().withColumn("__fresh", F.lit(True))
    return clusters.join(fresh, "circuit", "left").where(F.col("__fresh").isNull() | F.col("fixture_id").isNotNull()).drop("__fresh")


def unlinked(events: DataFrame) -> DataFrame:
    """events after a set-up reset: no cluster, no fixture."""
    return events.withColumns({c: F.lit(None).cast(events.schema[c].dataType) for c in ("cluster_id", "fixture_id")})


def idle(states: DataFrame) -> DataFrame:
    return states.withColumns({"state": F.lit("idle"), "events_collected": F.lit(0).cast("long")})


def fixtures_from_clusters(clusters: DataFrame, named: DataFrame, stored: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """(fixtures, clusters) after naming clusters: named(circuit, cluster_id, name, fixture_type) confirms and locks a fixture each.

    A cluster with a fixture updates it; one without gets a new fixture of id new_id, an expression over named (deterministic, so that a lost
    task makes the same id again), and is linked to it. stored is (fixture_id, fixture_name, fixture_type, confirmed).
    """
    ours = named.join(clusters.select("circuit", "cluster_id", "fixture_id"), ["circuit", "cluster_id"])
    ours = ours.withColumns({"is_new": F.col("fixture_id").isNull(), "fixture_id": F.coalesce("fixture_id", new_id)})
    one = ours.groupBy("fixture_id").agg(F.max_by(F.struct("name", "fixture_type"), F.struct("circuit", "cluster_id")).alias("x"))
    changes = one.select("fixture_id", F.col("x.name").alias("fixture_name"), "x.fixture_type", F.lit(True).alias("confirmed"))
    fixtures = stored.join(changes.select("fixture_id"), "fixture_id", "left_anti").unionByName(changes)
    links = ours.where("is_new").select("circuit", "cluster_id", F.col("fixture_id").alias("__new"))
    linked = clusters.join(links, ["circuit", "cluster_id"], "left").withColumn("fixture_id", F.coalesce("fixture_id", "__new")).drop("__new")
    return fixtures, linked


def results_written(events: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """events with fields set from results(id, fields) where there is a result, nulls included; results are unique by id."""
    own = results.select("id", F.struct(*fields).alias("__found"))
    out = events.join(own, "id", "left")
    keep = lambda c: F.col(c) if c in events.columns else F.lit(None)
    return out.withColumns({c: F.when(F.col("__found").isNotNull(), F.col("__found")[c]).otherwise(keep(c)) for c in fields}).drop("__found")


def last_seen(events: DataFrame, clusters: DataFrame, fixtures: DataFrame, ts: str = "start_ts") -> DataFrame:
    """fixtures with last_seen_at, the latest event of any cluster that belongs to it (null if none)."""
    per_cluster = events.where("cluster_id is not null").groupBy("circuit", "cluster_id").agg(F.max(ts).alias("__at"))
    linked = per_cluster.join(clusters.where("fixture_id is not null").select("circuit", "cluster_id", "fixture_id"), ["circuit", "cluster_id"])
    return fixtures.join(linked.groupBy("fixture_id").agg(F.max("__at").alias("last_seen_at")), "fixture_id", "left")


def stable_ids(seen: DataFrame, stored: DataFrame, circuit: str = "circuit", learner_id: str = "learner_id", first: str = "first_at") -> DataFrame:
    """(circuit, learner_id, cluster_id): stored ids stay, a learner's id met for the first time takes the next free number of its circuit.

    New ids are numbered in the order of their first sight; the rows are clusters, not events, so a circuit's window is small.
    """
    from pyspark.sql import Window

    fresh = seen.groupBy(circuit, learner_id).agg(F.min(first).alias("__at")).join(stored.select(circuit, learner_id), [circuit, learner_id], "left_anti")
    top = stored.groupBy(circuit).agg(F.max("cluster_id").alias("__top"))
    place = F.row_number().over(Window.partitionBy(circuit).orderBy("__at", learner_id))
    new = fresh.join(top, circuit, "left").select(circuit, learner_id, (F.coalesce("__top", F.lit(0)) + place).cast("long").alias("cluster_id"))
    return stored.select(circuit, learner_id, F.col("cluster_id").cast("long").alias("cluster_id")).unionByName(new)


def catch_up_ranges(states: DataFrame, as_of: Column, most_days: int = 10) -> DataFrame:
    """(circuit, chunk, from_ts, to_ts): what an importer reads at start, in chunks of a day.

    It begins five minutes before the last event, or most_days ago where there is none (last_event null).
    """
    begin = F.coalesce(F.col("last_event") - F.expr("interval 5 minutes"), as_of - F.make_dt_interval(F.lit(most_days)))
    own = states.select("circuit", begin.alias("__from"))
    chunks = F.ceil((seconds(as_of) - seconds(F.col("__from"))) / 86400).cast("int")
    cut = own.where(F.col("__from") < as_of).select("circuit", "__from", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    day = lambda n: F.col("__from") + F.make_dt_interval(n)
    return cut.select("circuit", "chunk", day(F.col("chunk")).alias("from_ts"), F.least(day(F.col("chunk") + 1), as_of).alias("to_ts"))


def import_checkpoints(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """(circuit, last_check_ts, total_imported) after runs(circuit, run_at, imported, dropped_from): counts add up, and the checkpoint is
    that of the latest run: the earliest start that it dropped, else its own time."""
    last = runs.groupBy("circuit").agg(F.max_by(F.coalesce("dropped_from", "run_at"), "run_at").alias("__at"), F.sum("imported").alias("__n"))
    both = stored.join(last, "circuit", "full")
    return both.select("circuit", F.coalesce("__at", "last_check_ts").alias("last_check_ts"), (F.coalesce("total_imported", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("total_imported"))


def merge_archive(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after the merge, (before, after, added)): stored rows win, known columns only."""
    known = incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes])
    after = insert_missing(stored, known, keys)
    counts = stored.agg(F.count("*").alias("before")).join(F.broadcast(after.agg(F.count("*").alias("after"))))  # one row each
    return after, counts.withColumn("added", F.col("after") - F.col("before"))


def training_events(events: DataFrame, as_of: Column, days: int = 365, ts: str = "start_ts") -> DataFrame:
    """What a quick backup takes of a history table: the last days, in full."""
    return events.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def summary_range(events: DataFrame, summaries: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The events to summarise at start: all if nothing was ever summarised, else those of the last days."""
    any_row = summaries.limit(1).agg((F.count("*") > 0).alias("__any"))  # one row
    since = F.to_date(as_of) - F.expr(f"interval {days} days")
    return events.join(F.broadcast(any_row)).where(~F.col("__any") | (F.to_date("start_ts") >= since)).drop("__any")


def recalibration(rows: DataFrame, as_of: Column) -> DataFrame:
    """rows(circuit, fixtures_changed, occupants_changed) with action (full, partial or partial_restart) and accelerated_until."""
    action = F.when(F.col("fixtures_changed"), "full").when(F.col("occupants_changed"), "partial_restart").otherwise("partial")
    return rows.withColumns({"action": action, "accelerated_until": F.when(action != "full", as_of + F.expr("interval 14 days"))})


def due_tests(schedules: DataFrame, as_of: Column) -> DataFrame:
    """schedules(circuit, enabled, next_run, running) with due (schedule, run or wait): one without a time is scheduled, one whose time has
    come runs unless a test of its circuit is running."""
    due = F.when(~F.col("enabled"), "wait").when(F.col("next_run").isNull(), "schedule").when((F.col("next_run") <= as_of) & ~F.col("running"), "run").otherwise("wait")
    return schedules.withColumn("due", due)


def test_reports(tests: DataFrame, polls: DataFrame) -> DataFrame:
    """tests(test_id, run_at, minutes, baseline) with the outcome of their polls(test_id, ts, result, pressure).

    The first poll within 60 + 60 minutes + 120 seconds whose result is terminal ends a test; else it is timed out at that limit.
    """
    limit = F.col("minutes") * 60 + 180
    after = seconds(F.col("ts")) - seconds(F.col("run_at"))
    ends = polls.join(tests.select("test_id", "run_at", "minutes"), "test_id").where(F.col("result").isin(*TEST_RESULTS) & (after >= 0) & (after < limit))
    first = ends.groupBy("test_id").agg(F.min_by(F.struct("ts", "result", "pressure"), "ts").alias("x")).select("test_id", "x.*")
    out = tests.join(first, "test_id", "left")
    took = F.coalesce(seconds(F.col("ts")) - seconds(F.col("run_at")), limit.cast("double"))
    return out.select("test_id", F.coalesce("result", F.lit(TIMED_OUT)).alias("result"), F.round(took / 60, 1).alias("duration_minutes"), F.round(F.col("baseline") - F.col("pressure"), 2).alias("pressure_drop"), F.coalesce(F.col("result") == TEST_RESULTS[0], F.lit(False)).alias("passed"))


def remaining_text(elapsed: Column, minutes: Column) -> Column:
    """How long a running test will last: settling for 60 seconds, then minutes and seconds."""
    left = F.lit(60) + minutes * 60 - elapsed
    whole = lambda c: F.floor(c).cast("int")
    m, s = whole(left / 60), whole(left % 60)
    return F.when(elapsed < 60, F.format_string("Settling… %ds", whole(60 - elapsed))).when(left <= 0, "Completing…").when(m > 0, F.format_string("%dm %02ds remaining", m, s)).otherwise(F.format_string("%ds remaining", s))


def calibration_days(full_baths: Column, half_baths: Column, floors: Column, occupants: Column, supply: Column) -> tuple[Column, Column]:
    """(days, size of home) by the number of fixtures that a home is expected to have."""
    n = full_baths * 3.2 + half_baths * 1.2 + floors * 0.5 + 2.0
    tier = F.when(n <= 8, "small").when(n <= 14, "medium").when(n <= 20, "large").otherwise("mansion")
    base = F.when(n <= 14, 14).when(n <= 20, 21).otherwise(28)
    base = F.when(occupants >= 6, F.least(base + 7, F.lit(28))).when((occupants >= 4) & (n > 14), F.least(base + 3, F.lit(28))).otherwise(base)
    return F.least(F.when(supply == "well", base + 7).otherwise(base), F.lit(35)), tier


def alert_texts(alerts: DataFrame) -> DataFrame:
    """alerts(alert_type, name, value, threshold, minutes, unit; values in the display unit, as text) with title, message and critical.

    Types: pressure_drop, high_flow, trickle, flow_anomaly, leak_failed, leak_passed; others get no text. High flow and a failed test are critical.
    """
    say = F.format_string
    texts = {
        "pressure_drop": ("⚠ Pressure drop — %s", say("Rapid pressure drop of %s %s detected. Possible burst pipe or demand surge.", "value", "unit")),
        "high_flow": ("🚨 High flow alert — %s", say("Flow rate %s %s exceeds threshold %s %s. Possible burst pipe. Valve has been closed.", "value", "unit", "threshold", "unit")),
        "trickle": ("💧 Trickle flow alert — %s", say("Sustained low flow of %s %s for %s minutes. Possible running toilet or dripping tap.", "value", "unit", "minutes")),
        "flow_anomaly": ("🔍 Unusual flow pattern — %s", say("Flow pattern did not match any known fixture (anomaly score %s%%). Review the History page for details.", "value")),
        "leak_failed": ("🔴 Leak detected — %s", say("Micro leak test detected pressure decay of %s %s. A slow leak may be present. Check the History page.", "value", "unit")),
        "leak_passed": ("✅ Leak test passed — %s", say("No leak detected in %s-minute test. Pressure was stable throughout.", "minutes")),
    }
    title = message = F.lit(None).cast("string")
    for kind, (head, text) in texts.items():
        own = F.col("alert_type") == kind
        title, message = F.when(own, say(head, "name")).otherwise(title), F.when(own, text).otherwise(message)
    return alerts.withColumns({"title": title, "message": message, "critical": F.col("alert_type").isin("high_flow", "leak_failed")})


def or_default(keys: DataFrame, stored: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """The stored row of each key, or the defaults where there is none."""
    found = stored.select(key, F.struct(*defaults).alias("__row"))
    return keys.join(found, key, "left").select(key, *[F.when(F.col("__row").isNotNull(), F.col("__row")[c]).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()])


def valid_or_default(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def review_bucket(confirmed: Column, confidence: Column) -> tuple[Column, Column]:
    """(needs review, pill): unconfirmed under 0.65; high from 0.85, medium from 0.65, else low."""
    return ~confirmed & (F.coalesce(confidence, F.lit(0.0)) < 0.65), F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "medium").otherwise("low")


def updated_singleton(row: DataFrame, changes: Mapping[str, object], allowed: list[str]) -> DataFrame:
    """The one settings row with changes; a name that is not allowed raises."""
    unknown = sorted(set(changes) - set(allowed))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return row.withColumns({c: F.lit(v).cast(row.schema[c].dataType) for c, v in changes.items()})


def short_baseline(own: Column, buffer: Column) -> Column:
    """The baseline, else the mean of the whole short buffer, else 0."""
    mean = F.try_divide(F.aggregate(buffer, F.lit(0.0), lambda a, x: a + x), F.size(buffer))
    return F.coalesce(own, mean, F.lit(0.0))
