"""Set-up, training and test upkeep, backups and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import maintenance, relational, upkeep
from tidewatch.queries import AS_OF, query
from tidewatch.sources.history import clusters, fixtures, readings, table, usage_events

NOW = f"TIMESTAMP '{AS_OF}'"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def by_circuit(u):
    return u.groupBy("circuit").agg(F.count("*").alias("n"), F.max("start_ts").alias("last_at"), F.min("start_ts").alias("first_at"))


@query("SELECT id, circuit, has_pressure_transient AND id % 4 = 0 OR EXISTS (SELECT 1 FROM (SELECT circuit, start_ts AS a, start_ts + INTERVAL 2 HOUR AS b FROM u WHERE anomaly_score >= 0.97) w WHERE w.circuit = u.circuit AND u.start_ts BETWEEN a AND b) AS excluded_from_training FROM u")
def flt06(spark, d):
    u = usage_events(spark, d).withColumn("is_composite", F.expr("has_pressure_transient and id % 4 = 0"))
    windows = u.where("anomaly_score >= 0.97").select("circuit", F.col("start_ts").alias("started_at"), F.expr("start_ts + interval 2 hours").alias("ends_at"))
    return upkeep.excluded_from_training(u, windows).select("id", "circuit", "excluded_from_training")


@query("SELECT name, circuit, n FROM (SELECT 'events' AS name, circuit, count(*) AS n FROM u GROUP BY circuit UNION ALL SELECT 'clusters', circuit, count(*) FROM clusters GROUP BY circuit) WHERE circuit NOT IN ('click', 'view')")
def dml08(spark, d):
    u = usage_events(spark, d)
    left = upkeep.without_circuits({"events": u.select("circuit"), "clusters": clusters(u).select("circuit")}, u.where("circuit in ('click', 'view')"))
    parts = [rows.groupBy("circuit").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "circuit", "n") for name, rows in left.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT circuit, cluster_id, fixture_id FROM clusters WHERE circuit >= 'e' OR fixture_id IS NOT NULL")
def dml09(spark, d):
    u = usage_events(spark, d)
    return upkeep.without_unconfirmed(clusters(u), u.where("circuit < 'e'")).select("circuit", "cluster_id", "fixture_id")


@query("SELECT id, circuit, CAST(NULL AS INTEGER) AS cluster_id, CAST(NULL AS VARCHAR) AS fixture_id FROM u")
def dml10(spark, d):
    return upkeep.unlinked(usage_events(spark, d)).select("id", "circuit", "cluster_id", "fixture_id")


@query("SELECT circuit, 'idle' AS state, CAST(0 AS BIGINT) AS events_collected FROM u GROUP BY circuit")
def dml10_states(spark, d):
    states = by_circuit(usage_events(spark, d)).select("circuit", F.lit("live").alias("state"), F.col("n").alias("events_collected"))
    return upkeep.idle(states)


NAMED = "named AS (SELECT circuit, cluster_id, 'Named ' || circuit || ' ' || cluster_id AS name, CASE WHEN cluster_id < 4 THEN 'toilet' ELSE 'bath' END AS fixture_type FROM clusters WHERE cluster_id IN (1, 2, 3, 6))"


def named_clusters(own):
    return own.where("cluster_id in (1, 2, 3, 6)").select("circuit", "cluster_id", F.concat_ws(" ", F.lit("Named"), "circuit", F.col("cluster_id").cast("string")).alias("name"), F.when(F.col("cluster_id") < 4, "toilet").otherwise("bath").alias("fixture_type"))


def named_fixtures(spark, d):
    own = clusters(usage_events(spark, d))
    new_id = F.concat_ws("-", F.lit("new"), "circuit", F.col("cluster_id").cast("string"))
    return upkeep.fixtures_from_clusters(own, named_clusters(own), fixtures(spark), new_id)


@query(f""", {NAMED}, j AS (SELECT n.*, coalesce(c.fixture_id, 'new-' || n.circuit || '-' || n.cluster_id) AS fixture_id FROM named n JOIN clusters c USING (circuit, cluster_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY circuit DESC, cluster_id DESC) AS p FROM j)
 SELECT fixture_id, fixture_name, fixture_type, confirmed FROM fixtures WHERE fixture_id NOT IN (SELECT fixture_id FROM j) UNION ALL SELECT fixture_id, name, fixture_type, true FROM o WHERE p = 1""")
def dml13(spark, d):
    return named_fixtures(spark, d)[0]


@query("SELECT circuit, cluster_id, coalesce(fixture_id, CASE WHEN cluster_id IN (1, 2, 3, 6) THEN 'new-' || circuit || '-' || cluster_id END) AS fixture_id FROM clusters")
def dml13_links(spark, d):
    return named_fixtures(spark, d)[1].select("circuit", "cluster_id", "fixture_id")


@query("SELECT id, circuit, CASE WHEN id % 3 <> 0 THEN cluster_id WHEN id % 2 = 0 THEN 77 END AS cluster_id, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'type_gate' END AS match_rejection_reason FROM u")
def dml14(spark, d):
    u = usage_events(spark, d)
    even = F.col("id") % 2 == 0
    results = u.where("id % 3 = 0").select("id", F.when(even, 77).cast("int").alias("cluster_id"), F.when(~even, "type_gate").alias("match_rejection_reason"))
    return upkeep.results_written(u, results, ["cluster_id", "match_rejection_reason"]).select("id", "circuit", "cluster_id", "match_rejection_reason")


@query("SELECT f.fixture_id, max(u.start_ts) AS last_seen_at FROM fixtures f LEFT JOIN clusters c ON c.fixture_id = f.fixture_id LEFT JOIN u ON u.circuit = c.circuit AND u.cluster_id = c.cluster_id GROUP BY f.fixture_id")
def dml18(spark, d):
    u = usage_events(spark, d)
    return upkeep.last_seen(u, clusters(u), fixtures(spark)).select("fixture_id", "last_seen_at")


@query("""SELECT circuit, learner_id, CASE WHEN learner_id < 3 THEN learner_id + 1 ELSE 3 + row_number() OVER (PARTITION BY circuit, learner_id < 3 ORDER BY seen_at, learner_id) END AS cluster_id
 FROM (SELECT circuit, user_id % 9 AS learner_id, min(start_ts) AS seen_at FROM u GROUP BY ALL)""")
def clu07(spark, d):
    u = usage_events(spark, d).withColumn("learner_id", F.col("user_id") % 9)
    stored = u.where("learner_id < 3").select("circuit", "learner_id", (F.col("learner_id") + 1).alias("cluster_id")).distinct()
    return upkeep.stable_ids(u, stored, first="start_ts")


@query(f"SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{v}', {str(k not in upkeep.INTERNAL_TYPES).lower()})" for i, (k, v) in enumerate(upkeep.FIXTURE_TYPES.items()))}) t(place, fixture_type, label, selectable)")
def clu14(spark, d):
    rows = [(i, k, v) for i, (k, v) in enumerate(upkeep.FIXTURE_TYPES.items())]
    return spark.createDataFrame(rows, "place int, fixture_type string, label string").withColumn("selectable", ~F.col("fixture_type").isin(*upkeep.INTERNAL_TYPES))


@query("SELECT id, suggested_type, fixture_label FROM (SELECT u.id, c.suggested_type, CASE c.suggested_type WHEN 'toilet' THEN 'Toilet' WHEN 'shower' THEN 'Shower' END AS fixture_label FROM u LEFT JOIN clusters c USING (circuit, cluster_id))")
def clu13(spark, d):
    """Types are read anew with each run: an event's label follows its cluster's type as stored now."""
    u = usage_events(spark, d)
    labels = F.create_map(*[F.lit(x) for kv in upkeep.FIXTURE_TYPES.items() for x in kv])
    return u.join(clusters(u).select("circuit", "cluster_id", "suggested_type"), ["circuit", "cluster_id"], "left").select("id", "suggested_type", F.try_element_at(labels, F.col("suggested_type")).alias("fixture_label"))


@query(f""", s AS (SELECT circuit, CASE WHEN circuit = 'error' THEN {NOW} - INTERVAL 10 DAY ELSE max(start_ts) - INTERVAL 5 MINUTE END AS f FROM u WHERE start_ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY circuit)
SELECT circuit, chunk, f + to_days(chunk) AS from_ts, least(f + to_days(chunk + 1), {NOW}) AS to_ts FROM (SELECT circuit, f, CAST(unnest(range(0, CAST(ceil((epoch_us({NOW}) - epoch_us(f)) / 86400e6) AS BIGINT))) AS INTEGER) AS chunk FROM s)""")
def str03(spark, d):
    own = by_circuit(usage_events(spark, d).where("start_ts < timestamp_ntz'2024-01-15 00:00:00'"))
    return upkeep.catch_up_ranges(own.select("circuit", F.when(F.col("circuit") != "error", F.col("last_at")).alias("last_event")), now())


@query("SELECT circuit, arg_max(CASE WHEN id % 4 = 1 THEN start_ts - INTERVAL 1 HOUR ELSE start_ts END, (start_ts, id)) AS last_check_ts, CAST(sum(k) + CASE WHEN circuit < 'e' THEN 1000 ELSE 0 END AS BIGINT) AS total_imported FROM (SELECT *, CAST(duration_seconds AS BIGINT) AS k FROM u) GROUP BY circuit")
def snk07(spark, d):
    """Each event stands for one import run; a quarter of the runs dropped something an hour before."""
    u = usage_events(spark, d)
    stored = u.where("circuit < 'e'").select("circuit", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_check_ts"), F.lit(1000).cast("long").alias("total_imported")).distinct()
    last = u.groupBy("circuit", "start_ts").agg(F.max("id").alias("__id"))  # of two runs at one time the later id counts
    runs = u.join(last, ["circuit", "start_ts"]).select("circuit", F.col("start_ts").alias("run_at"), F.col("duration_seconds").cast("long").alias("imported"), F.when(F.expr("__id % 4 = 1"), F.expr("start_ts - interval 1 hour")).alias("dropped_from"))
    return upkeep.import_checkpoints(stored, runs)


@query("SELECT name, n FROM (SELECT 'clusters' AS name, count(*) AS n FROM clusters UNION ALL SELECT 'events', count(*) FROM u WHERE start_ts >= TIMESTAMP '2024-01-10 12:00:00')")
def snk09(spark, d):
    u = usage_events(spark, d)
    tables = {"events": upkeep.training_events(u, now(), 10), "clusters": clusters(u)}
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in tables.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT id, circuit, start_ts FROM u WHERE start_ts >= TIMESTAMP '2024-01-10 12:00:00'")
def src08(spark, d):
    """A backup written as one folder of JSON lines a table and read back: the loaded rows replace the table's."""
    import uuid

    from tidewatch.sources.history import read_archive, shared_folder, write_backup

    u = upkeep.training_events(usage_events(spark, d), now(), 10).select("id", "circuit", "start_ts")
    path = f"{shared_folder(spark)}/tidewatch/backup-{uuid.uuid4().hex}"
    write_backup({"events": u.withColumn("unknown", F.lit(1))}, path)
    return read_archive(spark, path, "events", u.schema)


ARCHIVE = ["id", "circuit", "cluster_id"]
#: What is stored, and what an archive brings: they overlap by four days.
BEFORE_ARCHIVE, IN_ARCHIVE = "start_ts < timestamp_ntz'2024-01-16 00:00:00'", "start_ts >= timestamp_ntz'2024-01-12 00:00:00'"


@query("SELECT id, circuit, CASE WHEN start_ts < TIMESTAMP '2024-01-16 00:00:00' THEN CAST(NULL AS INTEGER) ELSE cluster_id END AS cluster_id FROM u")
def src09(spark, d):
    u = usage_events(spark, d)
    stored = u.where(BEFORE_ARCHIVE).select("id", "circuit", F.lit(None).cast("int").alias("cluster_id"))
    incoming = u.where(IN_ARCHIVE).select(*ARCHIVE, F.lit("x").alias("unknown"))
    return upkeep.merge_archive(stored, incoming, ["id"])[0]


@query("SELECT before, after, after - before AS added FROM (SELECT count(*) FILTER (start_ts < TIMESTAMP '2024-01-16 00:00:00') AS before, count(*) AS after FROM u)")
def src09_counts(spark, d):
    u = usage_events(spark, d)
    return upkeep.merge_archive(u.where(BEFORE_ARCHIVE).select(*ARCHIVE), u.where(IN_ARCHIVE).select(*ARCHIVE), ["id"])[1]


@query("SELECT circuit, fixtures_changed, occupants_changed, CASE WHEN fixtures_changed THEN 'full' WHEN occupants_changed THEN 'partial_restart' ELSE 'partial' END AS action, CASE WHEN NOT fixtures_changed THEN TIMESTAMP '" + AS_OF + "' + INTERVAL 14 DAY END AS accelerated_until FROM (SELECT circuit, count(*) % 2 = 0 AS fixtures_changed, count(*) % 3 = 0 AS occupants_changed FROM u GROUP BY circuit)")
def st12(spark, d):
    own = by_circuit(usage_events(spark, d)).select("circuit", F.expr("n % 2 = 0").alias("fixtures_changed"), F.expr("n % 3 = 0").alias("occupants_changed"))
    return upkeep.recalibration(own, now())


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 'wait' WHEN id % 7 = 0 THEN 'schedule' WHEN start_ts <= {NOW} AND id % 11 <> 0 THEN 'run' ELSE 'wait' END AS due FROM u")
def st13(spark, d):
    own = usage_events(spark, d).select("id", F.expr("id % 5 <> 0").alias("enabled"), F.when(F.expr("id % 7 <> 0"), F.col("start_ts")).alias("next_run"), F.expr("id % 11 = 0").alias("running"))
    return upkeep.due_tests(own, now()).select("id", "due")


@query("SELECT 'empty' AS kind, count(*) AS n FROM u UNION ALL SELECT 'filled', count(*) FROM u WHERE CAST(start_ts AS DATE) >= DATE '2024-01-13'")
def st14(spark, d):
    u = usage_events(spark, d)
    days = u.select("circuit", F.to_date("start_ts").alias("day")).distinct()
    parts = [upkeep.summary_range(u, s, now()).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, s in (("empty", days.where("false")), ("filled", days))]
    return parts[0].unionByName(parts[1])


_PASSED, _FAILED = upkeep.TEST_RESULTS[:2]


@query(f""", t AS (SELECT CAST(CAST(start_ts AS DATE) AS VARCHAR) || circuit AS test_id, min(start_ts) AS run_at, 240 AS minutes, 50e0 AS baseline FROM u GROUP BY ALL),
p AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || circuit AS test_id, ts, id, CASE WHEN sensor = 1 THEN '{_PASSED}' WHEN sensor = 2 THEN '{_FAILED}' END AS result, value AS pressure FROM r),
f AS (SELECT test_id, arg_min(ts, (ts, id)) AS ts, arg_min(result, (ts, id)) AS result, arg_min(pressure, (ts, id)) AS pressure FROM p JOIN t USING (test_id) WHERE result IS NOT NULL AND ts >= run_at AND epoch_us(ts) - epoch_us(run_at) < 14580000000 GROUP BY test_id)
SELECT test_id, coalesce(result, '{upkeep.TIMED_OUT}') AS result, round(coalesce((epoch_us(ts) - epoch_us(run_at)) / 1e6, 14580e0) / 60 + 1e-9, 1) AS duration_minutes, round(50e0 - pressure + 1e-9, 2) AS pressure_drop, coalesce(result = '{_PASSED}', false) AS passed FROM t LEFT JOIN f USING (test_id)""")
def st05(spark, d):
    key = lambda ts: F.concat(F.to_date(ts).cast("string"), F.col("circuit"))
    tests = usage_events(spark, d).groupBy(key("start_ts").alias("test_id")).agg(F.min("start_ts").alias("run_at")).withColumns({"minutes": F.lit(240), "baseline": F.lit(50.0)})
    polls = readings(spark, d).select(key("ts").alias("test_id"), "ts", F.when(F.col("sensor") == 1, _PASSED).when(F.col("sensor") == 2, _FAILED).alias("result"), F.col("value").alias("pressure"))
    return upkeep.test_reports(tests, polls)


@query("""SELECT id, CASE WHEN e < 60 THEN 'Settling… ' || CAST(floor(60 - e) AS INTEGER) || 's' WHEN l <= 0 THEN 'Completing…' WHEN l >= 60 THEN CAST(floor(l / 60) AS INTEGER) || 'm ' || printf('%02d', CAST(floor(l % 60) AS INTEGER)) || 's remaining' ELSE CAST(floor(l) AS INTEGER) || 's remaining' END AS etc
FROM (SELECT id, duration_seconds * 9 AS e, 60 + 10 * 60 - duration_seconds * 9 AS l FROM u)""")
def st11(spark, d):
    return usage_events(spark, d).select("id", upkeep.remaining_text(F.col("duration_seconds") * 9, F.lit(10)).alias("etc"))


@query("""SELECT id, alert_type, CASE alert_type WHEN 'pressure_drop' THEN '⚠ Pressure drop — ' || circuit WHEN 'high_flow' THEN '🚨 High flow alert — ' || circuit WHEN 'trickle' THEN '💧 Trickle flow alert — ' || circuit ELSE '✅ Leak test passed — ' || circuit END AS title,
CASE alert_type WHEN 'pressure_drop' THEN 'Rapid pressure drop of ' || v || ' gpm detected. Possible burst pipe or demand surge.' WHEN 'high_flow' THEN 'Flow rate ' || v || ' gpm exceeds threshold 9 gpm. Possible burst pipe. Valve has been closed.'
 WHEN 'trickle' THEN 'Sustained low flow of ' || v || ' gpm for 4 minutes. Possible running toilet or dripping tap.' ELSE 'No leak detected in 4-minute test. Pressure was stable throughout.' END AS message, alert_type = 'high_flow' AS critical
FROM (SELECT id, circuit, printf('%.2f', round(avg_flow_lpm * 0.264172e0, 2)) AS v, CASE id % 4 WHEN 0 THEN 'pressure_drop' WHEN 1 THEN 'high_flow' WHEN 2 THEN 'trickle' ELSE 'leak_passed' END AS alert_type FROM u)""")
def snk18(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("pressure_drop", "high_flow", "trickle", "leak_passed")])
    value = F.format_string("%.2f", scalars.in_unit(F.col("avg_flow_lpm"), "gpm", scalars.FLOW_UNITS))
    own = usage_events(spark, d).select("id", F.get(kinds, (F.col("id") % 4).cast("int")).alias("alert_type"), F.col("circuit").alias("name"), value.alias("value"), F.lit("9").alias("threshold"), F.lit("4").alias("minutes"), F.lit("gpm").alias("unit"))
    return upkeep.alert_texts(own).select("id", "alert_type", "title", "message", "critical")


@query("SELECT circuit, coalesce(state, 'idle') AS state, coalesce(minimum_events, 50) AS minimum_events FROM (SELECT DISTINCT circuit FROM u) LEFT JOIN (SELECT circuit, 'live' AS state, 100 AS minimum_events FROM u WHERE circuit < 'e' GROUP BY circuit) USING (circuit)")
def flt13(spark, d):
    u = usage_events(spark, d)
    stored = u.where("circuit < 'e'").select("circuit", F.lit("live").alias("state"), F.lit(100).alias("minimum_events")).distinct()
    return upkeep.or_default(u.select("circuit").distinct(), stored, "circuit", {"state": "idle", "minimum_events": 50})


@query("SELECT circuit, NOT bool_or(NOT matched AND NOT optional) AS all_matched, coalesce(string_agg(role, ',' ORDER BY role) FILTER (NOT matched AND NOT optional), '') AS unmatched FROM (SELECT circuit, 's' || sensor AS role, max(value) > 80 AS matched, sensor >= 6 AS optional FROM r GROUP BY circuit, sensor) GROUP BY circuit")
def flt14(spark, d):
    own = readings(spark, d).groupBy("circuit", "sensor").agg((F.max("value") > 80).alias("matched"))
    return upkeep.unmatched_required(own.select("circuit", F.concat(F.lit("s"), F.col("sensor").cast("string")).alias("role"), "matched", (F.col("sensor") >= 6).alias("optional")))


@query("SELECT id, CASE WHEN circuit IN ('click', 'view') THEN circuit ELSE 'other' END AS circuit FROM u")
def flt16(spark, d):
    return usage_events(spark, d).select("id", upkeep.valid_or_default(F.col("circuit"), ["click", "view"], "other").alias("circuit"))


@query("SELECT circuit, cluster_id, fixture_id IS NULL AND suggested_confidence < 0.65 AS needs_review, CASE WHEN suggested_confidence >= 0.85 THEN 'high' WHEN suggested_confidence >= 0.65 THEN 'medium' ELSE 'low' END AS pill FROM clusters")
def flt10(spark, d):
    review, pill = upkeep.review_bucket(F.col("fixture_id").isNotNull(), F.col("suggested_confidence"))
    return clusters(usage_events(spark, d)).select("circuit", "cluster_id", review.alias("needs_review"), pill.alias("pill"))


@query("SELECT circuit, count(*) FILTER (fixture_id IS NULL AND circuit NOT IN ('click', 'error')) AS unreviewed FROM clusters GROUP BY circuit")
def flt12(spark, d):
    counted = F.col("fixture_id").isNull() & ~F.col("state").isin("idle", "calibrating")
    state = F.when(F.col("circuit") == "click", "idle").when(F.col("circuit") == "error", "calibrating").otherwise("live")
    return clusters(usage_events(spark, d)).withColumn("state", state).groupBy("circuit").agg(F.count(F.when(counted, 1)).alias("unreviewed"))


@query("SELECT CAST(2.5 AS DOUBLE) AS pressure_drop, CAST(3 AS INTEGER) AS minutes, 'weekly' AS frequency")
def dml17(spark, d):
    row = spark.createDataFrame([(1.0, 3, "daily")], "pressure_drop double, minutes int, frequency string")
    return upkeep.updated_singleton(row, {"pressure_drop": 2.5, "frequency": "weekly"}, row.columns)


@query("SELECT circuit, list_sort(list_distinct(list(user_id % 12) FILTER (cluster_id = 1) || list(user_id % 12) FILTER (triggered_alert))) AS ids FROM u GROUP BY circuit")
def set03(spark, d):
    u = usage_events(spark, d)
    part = lambda c: F.collect_set(F.when(c, F.col("user_id") % 12))  # noqa: E731  at most twelve values
    own = u.groupBy("circuit").agg(part(F.col("cluster_id") == 1).alias("a"), part(F.col("triggered_alert")).alias("b"))
    return own.select("circuit", F.sort_array(F.array_union("a", "b")).alias("ids"))


@query("SELECT event_id AS id, value FROM events")
def set05(spark, d):
    own = table(spark, d, "events").withColumnRenamed("event_id", "id")
    return maintenance.known_columns(own, ["id", "value", "missing"])


@query(f""", h AS (SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, sum(volume_litres) AS volume FROM u GROUP BY ALL)
SELECT circuit, hour_ts, round(coalesce(volume, 0e0) + 1e-9, 2) AS volume FROM (SELECT circuit, unnest(generate_series(date_trunc('hour', {NOW}) - INTERVAL 11 HOUR, date_trunc('hour', {NOW}), INTERVAL 1 HOUR)) AS hour_ts FROM (SELECT DISTINCT circuit FROM u)) LEFT JOIN h USING (circuit, hour_ts)""")
def win20(spark, d):
    """The last 12 of the day's 24 hours."""
    from tidewatch.operators import rollups

    u = usage_events(spark, d)
    series = rollups.day_series(rollups.hourly_volume(u), u.select("circuit").distinct(), now())
    return series.where(F.col("hour_ts") > F.date_trunc("hour", now()).cast("timestamp_ntz") - F.expr("interval 12 hours"))


@query("SELECT id, CASE WHEN pressure_delta_psi > 2 THEN pre_event_pressure_psi WHEN user_id % 3 = 0 THEN 0e0 ELSE (min_pressure_psi + pre_event_pressure_psi) / 2 END AS baseline FROM u")
def win06(spark, d):
    own = F.when(F.col("pressure_delta_psi") > 2, F.col("pre_event_pressure_psi"))
    buffer = F.when(F.expr("user_id % 3 = 0"), F.array().cast("array<double>")).otherwise(F.array("min_pressure_psi", "pre_event_pressure_psi"))
    return usage_events(spark, d).select("id", upkeep.short_baseline(own, buffer).alias("baseline"))


@query("SELECT circuit, CAST(start_ts AS DATE) AS day, fixture_id, count(*) AS event_count FROM u WHERE fixture_id IS NOT NULL AND NOT (CAST(start_ts AS DATE) = DATE '2024-01-03' AND id % 2 = 1) GROUP BY ALL")
def snk05(spark, d):
    """Days of fixtures, one of them summarised again from its even events and replaced."""
    from tidewatch.operators import rollups

    u = usage_events(spark, d)
    own = rollups.fixture_days(u).select("circuit", "fixture_id", "day", "event_count").withColumn("seq", F.lit(1))
    again = rollups.fixture_days(u.where("to_date(start_ts) = date'2024-01-03' and id % 2 = 0")).select("circuit", "fixture_id", "day", "event_count").withColumn("seq", F.lit(2))
    kept = own.where("day <> date'2024-01-03'").unionByName(own.where("day = date'2024-01-03'").join(again.select("circuit", "fixture_id", "day"), ["circuit", "fixture_id", "day"], "left_semi"))
    return maintenance.replace_rows(kept, again, ["circuit", "fixture_id", "day"], "seq").drop("seq")


@query("""SELECT circuit, hour_ts, n FROM (SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, count(*) AS n FROM u GROUP BY ALL) h WHERE hour_ts >= TIMESTAMP '2024-01-10 00:00:00'
OR EXISTS (SELECT 1 FROM u w WHERE w.circuit = h.circuit AND w.anomaly_score >= 0.97 AND h.hour_ts BETWEEN w.start_ts AND w.start_ts + INTERVAL 5 HOUR)""")
def dml02(spark, d):
    hours = usage_events(spark, d).groupBy("circuit", F.date_trunc("hour", "start_ts").cast("timestamp_ntz").alias("hour_ts")).agg(F.count("*").alias("n"))
    windows = usage_events(spark, d).where("anomaly_score >= 0.97").select("circuit", F.col("start_ts").alias("started_at"), F.expr("start_ts + interval 5 hours").alias("ends_at"))
    return maintenance.retained(hours, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), windows, "hour_ts")


@query("SELECT id, circuit, ts FROM r WHERE circuit IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-08 00:00:00'")
def src02(spark, d):
    from tidewatch.sources.history import read_history

    span = [F.lit(f"2024-01-0{i} 00:00:00").cast("timestamp_ntz") for i in (5, 8)]
    return read_history(spark, f"{d}/events.parquet", ["click", "view"], *span, entity="event_type").select(F.col("event_id").alias("id"), F.col("event_type").alias("circuit"), "ts")


@query("SELECT p_brand AS device_id, count(*) AS n_entities, min(p_name) AS first_name FROM part GROUP BY p_brand")
def src05(spark, d):
    """The registry's devices with the number of their entities."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("device_id")).agg(F.count("*").alias("n_entities"), F.min("p_name").alias("first_name"))


@query("SELECT 'main' AS circuit, 'fixture' AS circuit_type, true AS enabled UNION ALL SELECT 'irrigation', 'zone', true")
def src10(spark, d):
    """Circuits of an options text; one without any has the default two."""
    from tidewatch.sources.history import configured_circuits

    return configured_circuits(spark.createDataFrame([("{}",)], "options string"))


@query("SELECT id, round(CASE WHEN value < 0 OR value > 500 THEN 0e0 ELSE value END, 2) AS psi, CASE WHEN user_id % 4 = 0 THEN 0e0 WHEN user_id % 4 = 1 THEN -1e0 ELSE value END AS parsed FROM (SELECT event_id AS id, value, user_id FROM events)")
def scalar_parse(spark, d):
    text = F.when(F.expr("user_id % 4 = 0"), "0").when(F.expr("user_id % 4 = 1"), "unavailable").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(scalars.clean_pressure(F.col("value")), 2).alias("psi"), scalars.number(text, -1.0).alias("parsed"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN true ELSE p_size >= 35 END AS ok FROM part")
def scalar_version(spark, d):
    """3.5.1 is the least: sizes stand for the minor version; without a number a device passes."""
    text = F.when(F.expr("p_size % 5 = 0"), F.lit(None).cast("string")).when(F.expr("p_size % 5 = 1"), "dev").otherwise(F.format_string("%d.%d.1 (build 2024.1)", F.expr("p_size div 10"), F.expr("p_size % 10")))
    return table(spark, d, "part").select("p_partkey", scalars.version_at_least(text, (3, 5, 1)).alias("ok"))


@query("SELECT id, CASE WHEN avg_flow_lpm >= 0.05 AND has_pressure_transient AND pressure_delta_psi > 0 THEN round(pressure_delta_psi / avg_flow_lpm + 1e-9, 4) END AS resistance, round(coalesce(CASE WHEN id % 3 = 0 THEN 7.5e0 END, avg_flow_lpm * duration_seconds / 60) + 1e-9, 4) AS volume FROM u")
def scalar_hydraulics(spark, d):
    flow = F.col("avg_flow_lpm")
    resistance = scalars.resistance(flow, F.col("pressure_delta_psi"), F.col("has_pressure_transient"))
    volume = scalars.volume(F.when(F.expr("id % 3 = 0"), 7.5), flow, F.col("duration_seconds"))
    return usage_events(spark, d).select("id", F.round(resistance + 1e-9, 4).alias("resistance"), F.round(volume + 1e-9, 4).alias("volume"))


@query("""SELECT p_partkey, round(n, 1) AS fixtures, CAST(greatest(floor(n * 15), 50) AS BIGINT) AS minimum_events, CASE WHEN n <= 8 THEN 'small' WHEN n <= 14 THEN 'medium' WHEN n <= 20 THEN 'large' ELSE 'mansion' END AS tier,
CAST(least(CASE WHEN w THEN b + 7 ELSE b END, 35) AS INTEGER) AS days FROM (SELECT *, CASE WHEN o >= 6 THEN least(b0 + 7, 28) WHEN o >= 4 AND n > 14 THEN least(b0 + 3, 28) ELSE b0 END AS b
 FROM (SELECT p_partkey, p_size % 7 AS o, p_size % 2 = 0 AS w, (p_size % 5) * 3.2e0 + (p_size % 3) * 1.2e0 + (p_size % 4) * 0.5e0 + 2e0 AS n, CASE WHEN n <= 14 THEN 14 WHEN n <= 20 THEN 21 ELSE 28 END AS b0 FROM part))""")
def scalar_sizing(spark, d):
    full, half, floors = (F.expr(f"p_size % {n}") for n in (5, 3, 4))
    n, events = scalars.minimum_events(full, half, floors)
    days, tier = upkeep.calibration_days(full, half, floors, F.expr("p_size % 7"), F.when(F.expr("p_size % 2 = 0"), "well").otherwise("city"))
    return table(spark, d, "part").select("p_partkey", F.round(n, 1).alias("fixtures"), events.cast("long").alias("minimum_events"), tier.alias("tier"), days.cast("int").alias("days"))


ROLE_ENTITIES = """, e AS (SELECT event_id % 40 AS device_id, CAST(event_id AS VARCHAR) AS entity_id, CASE event_id % 6 WHEN 0 THEN 'Water Pressure Main' WHEN 1 THEN 'Water Pressure Main (Fast)' WHEN 2 THEN 'Water Flow Rate Irrigation' WHEN 3 THEN 'Safety Fault Reason Main' WHEN 4 THEN 'Main Water Valve' ELSE 'Kitchen Lamp' END AS name,
 CASE event_id % 6 WHEN 3 THEN CASE WHEN event_id % 4 = 0 THEN 'binary_sensor' ELSE 'sensor' END WHEN 4 THEN 'valve' ELSE 'sensor' END AS domain FROM events)"""


@query(ROLE_ENTITIES + """ SELECT device_id, role, min(entity_id) AS entity_id FROM e JOIN (VALUES ('main.pressure_history_sensor', 'sensor', 'Water Pressure Main'), ('main.pressure_fast_sensor', 'sensor', 'Water Pressure Main (Fast)'), ('irrigation.flow_sensor', 'sensor', 'Water Flow Rate Irrigation'),
 ('main.fault_reason_sensor', 'sensor', 'Safety Fault Reason Main'), ('main.fault_sensor', 'binary_sensor', 'Safety Fault Reason Main'), ('main.valve_entity', 'valve', 'Main Water Valve')) v(role, dom, says) ON e.domain = v.dom AND e.name = v.says GROUP BY ALL""")
def role_match(spark, d):
    """All 28 role patterns on a registry whose names carry six of them."""
    i = F.col("event_id") % 6
    names = ["Water Pressure Main", "Water Pressure Main (Fast)", "Water Flow Rate Irrigation", "Safety Fault Reason Main", "Main Water Valve", "Kitchen Lamp"]
    domain = F.when((i == 3) & (F.col("event_id") % 4 == 0), "binary_sensor").when(i == 4, "valve").otherwise("sensor")
    own = table(spark, d, "events").select((F.col("event_id") % 40).alias("device_id"), F.col("event_id").cast("string").alias("entity_id"), F.get(F.array(*[F.lit(x) for x in names]), i.cast("int")).alias("name"), domain.alias("domain"))
    return relational.match_roles(own, upkeep.role_patterns())


@query("SELECT circuit, day, event_count FROM (SELECT circuit, CAST(start_ts AS DATE) AS day, count(*) AS event_count FROM u GROUP BY ALL ORDER BY circuit, day DESC LIMIT 50)")
def srt03(spark, d):
    """The first 50 days by circuit and falling day: a report's page."""
    days = usage_events(spark, d).groupBy("circuit", F.to_date("start_ts").alias("day")).agg(F.count("*").alias("event_count"))
    return days.orderBy("circuit", F.desc("day")).limit(50)


@query("SELECT circuit, start_ts, coalesce(max(id) FILTER (triggered_alert), min(id)) AS id FROM (SELECT id, circuit, date_trunc('hour', start_ts) AS start_ts, triggered_alert FROM u) GROUP BY ALL")
def str04(spark, d):
    """Events of hours; those with an alert are stored already (the last of an hour), the others come twice and are stored once where the hour has none."""
    u = usage_events(spark, d).withColumn("start_ts", F.date_trunc("hour", "start_ts").cast("timestamp_ntz"))
    stored = u.where("triggered_alert").groupBy("circuit", "start_ts").agg(F.max("id").alias("id")).select("id", "circuit", "start_ts")
    fresh = u.where("not triggered_alert").select("id", "circuit", "start_ts")
    return maintenance.insert_missing(stored, fresh.unionByName(fresh), ["circuit", "start_ts"]).select("circuit", "start_ts", "id")
