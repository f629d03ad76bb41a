"""Write semantics, scalar functions and state rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import maintenance, rollups, rules
from tidewatch.queries import AS_OF, query, settled
from tidewatch.sources.history import clusters, configurable_entities, normalised_history, readings, table, usage_events

COLUMNS = ["id", "circuit", "start_ts", "cluster_id", "volume_litres"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


VERSIONS = """v AS (SELECT id, circuit, date_trunc('hour', start_ts) AS start_ts, cluster_id, round(volume_litres, 4) AS volume_litres FROM u)"""


def versions(spark, d):
    """Events by the hour, so that a circuit has several of one start."""
    u = usage_events(spark, d).withColumns({"start_ts": F.date_trunc("hour", "start_ts").cast("timestamp_ntz"), "volume_litres": F.round("volume_litres", 4)})
    return u.select(*COLUMNS)


@query(f", {VERSIONS} SELECT id, circuit, start_ts, cluster_id, volume_litres FROM (SELECT *, row_number() OVER (PARTITION BY circuit, start_ts ORDER BY id % 3 = 0 DESC, id DESC) AS p FROM v) WHERE p = 1")
def snk01(spark, d):
    v = versions(spark, d)
    return maintenance.replace_rows(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), ["circuit", "start_ts"], "id").select(*COLUMNS)


@query("SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, round(sum(volume_litres), 4) AS volume FROM u GROUP BY ALL")
def snk02(spark, d):
    u = usage_events(spark, d)
    old, new = (rollups.hourly_volume(u.where(f"id % 2 = {i}")) for i in (0, 1))
    return maintenance.add_volumes(old, new, ["circuit", "hour_ts"], "volume").withColumn("volume", F.round("volume", 4))


@query("SELECT circuit, cluster_id, CASE WHEN cluster_id < 4 THEN 'renamed' ELSE suggested_type END AS suggested_type, member_count FROM clusters WHERE cluster_id <> 7 UNION ALL SELECT circuit, cluster_id, 'renamed', CAST(NULL AS BIGINT) FROM clusters WHERE cluster_id = 7")
def snk03(spark, d):
    own = clusters(usage_events(spark, d)).select("circuit", "cluster_id", "suggested_type", "member_count")
    changes = own.where("cluster_id < 4 or cluster_id = 7").select("circuit", "cluster_id", F.lit("renamed").alias("suggested_type"))
    return maintenance.update_fields(own.where("cluster_id <> 7"), changes, ["circuit", "cluster_id"])


@query("SELECT circuit, CAST(start_ts AS DATE) AS day, count(*) AS event_count, round(sum(volume_litres), 4) AS total_volume FROM u WHERE NOT (CAST(start_ts AS DATE) = DATE '2024-01-03' AND id % 2 = 1) GROUP BY ALL")
def snk04(spark, d):
    """Summaries of all days, of which one is summarised again from its even events."""
    u = usage_events(spark, d)
    own = rollups.daily_summary(u).select("circuit", "day", "event_count", F.round("total_volume", 4).alias("total_volume")).withColumn("computed_at", F.lit(1))
    again = rollups.daily_summary(u.where("to_date(start_ts) = date'2024-01-03' and id % 2 = 0")).select("circuit", "day", "event_count", F.round("total_volume", 4).alias("total_volume")).withColumn("computed_at", F.lit(2))
    return maintenance.replace_rows(own, again, ["circuit", "day"], "computed_at").drop("computed_at")


@query("SELECT circuit, cluster_id AS from_cluster, CAST(id % 4 AS BIGINT) AS to_cluster, count(*) AS count, round(avg(duration_seconds) + 1e-9, 4) AS mean_gap, max(start_ts) AS last_seen FROM u WHERE cluster_id IS NOT NULL GROUP BY ALL")
def snk06(spark, d):
    pairs = usage_events(spark, d).where("cluster_id is not null").select("circuit", F.col("cluster_id").alias("from_cluster"), (F.col("id") % 4).alias("to_cluster"), F.col("duration_seconds").alias("gap_seconds"), F.col("start_ts").alias("seen_at"))
    return maintenance.transitions(pairs).withColumn("mean_gap", settled("mean_gap", 4))


@query("SELECT x.circuit, x.alert_type FROM (SELECT DISTINCT circuit, CASE WHEN triggered_alert THEN 'high_flow' ELSE 'trickle' END AS alert_type FROM u) x WHERE x.alert_type = 'high_flow' OR x.circuit <> 'click'")
def snk14(spark, d):
    own = usage_events(spark, d).select("circuit", F.when(F.col("triggered_alert"), "high_flow").otherwise("trickle").alias("alert_type")).distinct()
    off = own.where("circuit = 'click'").withColumn("enabled", F.lit(False))
    return rules.alerts(own.withColumn("critical", F.col("alert_type") == "high_flow"), off).drop("critical")


@query("SELECT id, circuit FROM u WHERE start_ts >= TIMESTAMP '2024-01-20 00:00:00' OR EXISTS (SELECT 1 FROM (SELECT DISTINCT circuit, TIMESTAMP '2024-01-03 00:00:00' AS a, TIMESTAMP '2024-01-05 12:00:00' AS b FROM u WHERE circuit IN ('click', 'view')) w WHERE w.circuit = u.circuit AND u.start_ts BETWEEN a AND b)")
def dml01(spark, d):
    u = usage_events(spark, d)
    windows = u.where("circuit in ('click', 'view')").select("circuit").distinct().withColumns({"started_at": stamp("2024-01-03 00:00:00"), "ends_at": stamp("2024-01-05 12:00:00")})
    return maintenance.retained(u, stamp("2024-01-20 00:00:00"), windows).select("id", "circuit")


@query("SELECT id, circuit FROM u WHERE start_ts >= TIMESTAMP '2024-01-15 00:00:00'")
def dml03(spark, d):
    return usage_events(spark, d).where(F.col("start_ts") >= stamp("2024-01-15 00:00:00")).select("id", "circuit")


@query(f", {VERSIONS} SELECT id, circuit, start_ts, CASE WHEN n = 1 THEN cluster_id END AS cluster_id, volume_litres FROM (SELECT *, row_number() OVER (PARTITION BY circuit, start_ts ORDER BY id DESC) AS p, count(*) OVER (PARTITION BY circuit, start_ts) AS n FROM v) WHERE p = 1")
def dml04(spark, d):
    return maintenance.dedup_events(versions(spark, d), ["circuit", "start_ts"], "id", clear=["cluster_id"])


@query(f", {VERSIONS} SELECT id, circuit, start_ts, cluster_id, volume_litres FROM (SELECT *, row_number() OVER (PARTITION BY circuit, start_ts ORDER BY id) AS p FROM v) WHERE p = 1")
def dml05(spark, d):
    return maintenance.dedup_events(versions(spark, d), ["circuit", "start_ts"], "id", newest=False)


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'no time' ELSE strftime(CASE WHEN id % 3 = 0 THEN start_ts + INTERVAL 6 HOUR ELSE start_ts END, '%Y-%m-%dT%H:%M:%S+00:00') END AS ts FROM u")
def dml06(spark, d):
    """Times with an offset, with Z and without either; some are no times."""
    text = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("id") % 5 == 0, "no time").when(F.col("id") % 3 == 0, F.concat(text, F.lit("-06:00"))).when(F.col("id") % 3 == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    return usage_events(spark, d).select("id", maintenance.normal_timestamp(raw).alias("ts"))


@query("SELECT id, circuit, CASE WHEN cluster_id % 4 <> 1 THEN cluster_id END AS cluster_id FROM u")
def dml07(spark, d):
    u = usage_events(spark, d)
    return maintenance.forget_clusters(u, clusters(u).where("cluster_id % 4 = 1")).select("id", "circuit", "cluster_id")


ALERTS = [("high_flow", False, True), ("burst", False, True), ("trickle", False, True), ("pressure_drop", False, True), ("leak_failed", False, True), ("offline", False, False), ("zone_stuck", True, True), ("zone_dry", True, True)]


@query(", a AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {z}, {e})" for n, z, e in ALERTS) + ") v(alert_type, zone_only, enabled)) SELECT c.circuit, a.alert_type, CASE WHEN a.alert_type = 'burst' AND c.circuit < 'd' THEN false ELSE a.enabled END AS enabled FROM (SELECT DISTINCT circuit FROM u) c JOIN a ON NOT a.zone_only OR c.circuit = 'signup'")
def dml11(spark, d):
    own = usage_events(spark, d).select("circuit").distinct().withColumn("circuit_type", F.when(F.col("circuit") == "signup", "zone").otherwise("fixture"))
    stored = own.where("circuit < 'd'").select("circuit", F.lit("burst").alias("alert_type"), F.lit(False).alias("enabled"))
    return maintenance.seed_defaults(own, spark.createDataFrame(ALERTS, "alert_type string, zone_only boolean, enabled boolean"), stored)


@query("SELECT event_type AS entity_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts, CAST(event_id AS VARCHAR) AS state FROM events WHERE event_id % 7 <> 0")
def src03(spark, d):
    """Times as seconds and as ISO text; a seventh of the rows has none."""
    e = table(spark, d, "events")
    number = F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 2 == 0), F.format_string("%.6f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    text = F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 2 == 1), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = e.select(F.col("event_type").alias("entity_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("s"), F.col("event_id").cast("string").alias("state"), number.alias("lu"), text.alias("last_updated"))
    out = normalised_history(raw)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT entity_id FROM (SELECT lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS entity_id FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_name LIKE 'red%')")
def src06(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("friendly_name"))
    return configurable_entities(own, ["small", "economy"], "red").select("entity_id")


@query("SELECT id, CASE WHEN value > 200 OR value < 0.01 THEN 0e0 ELSE value END AS flow, round(greatest(0e0, least(104e0, value / 31e0 * (104.1172e0 + 9.4359e0) - 9.4359e0)), 2) AS psi, round(value / 396, 4) AS lpm FROM r")
def scalar_math(spark, d):
    v = F.col("value")
    return readings(spark, d).select("id", scalars.clean_flow(v).alias("flow"), scalars.pressure_from_volts(v / 10).alias("psi"), F.round(scalars.flow_from_counts(v), 4).alias("lpm"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, len(list_filter(string_split(p_brand, '#'), lambda x: trim(x) <> '')) AS n FROM part")
def scalar_string(spark, d):
    own = table(spark, d, "part")
    return own.select("p_partkey", scalars.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"), F.size(scalars.items(F.replace("p_brand", F.lit("#"), F.lit(",")))).cast("long").alias("n"))


@query("SELECT id, CAST(isodow(start_ts) - 1 AS INTEGER) AS dow, isodow(start_ts) >= 6 AS weekend, CAST(hour(start_ts) AS INTEGER) AS hr, CAST(date_trunc('month', start_ts) AS DATE) AS month FROM u")
def scalar_datetime(spark, d):
    dow = F.weekday("start_ts")
    return usage_events(spark, d).select("id", dow.alias("dow"), (dow >= 5).alias("weekend"), F.hour("start_ts").alias("hr"), F.trunc("start_ts", "month").alias("month"))


@query("SELECT id, round(avg_flow_lpm * 0.264172e0, 2) AS gpm, round(pressure_delta_psi * 0.0689476e0, 2) AS bar, round(volume_litres * 0.001e0, 3) AS m3 FROM u")
def scalar_units(spark, d):
    u = usage_events(spark, d)
    return u.select("id", scalars.in_unit(F.col("avg_flow_lpm"), "gpm", scalars.FLOW_UNITS).alias("gpm"), scalars.in_unit(F.col("pressure_delta_psi"), "bar", scalars.PRESSURE_UNITS).alias("bar"), scalars.in_unit(F.col("volume_litres"), "m3", scalars.VOLUME_UNITS).alias("m3"))


@query("""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS uid
FROM (SELECT id, sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode(circuit || '/' || strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'))) AS h FROM u)""")
def uuid5(spark, d):
    return usage_events(spark, d).select("id", scalars.event_id(F.col("circuit"), F.col("start_ts")).alias("uid"))


@query(f"SELECT circuit, CAST(least(100, greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(a)) / greatest(epoch(b) - epoch(a), 1) * 100))) AS BIGINT) AS percent_complete, CAST(floor(greatest(0, (epoch(b) - epoch(a)) - (epoch(TIMESTAMP '{AS_OF}') - epoch(a))) / 3600) AS BIGINT) AS hours_remaining FROM (SELECT circuit, min(start_ts) AS a, min(start_ts) + INTERVAL 28 DAY AS b FROM u GROUP BY circuit)")
def st03(spark, d):
    states = usage_events(spark, d).groupBy("circuit").agg(F.min("start_ts").alias("started_at")).withColumn("calibration_ends_at", F.expr("started_at + interval 28 days"))
    return rules.training_progress(states, stamp(AS_OF)).select("circuit", "percent_complete", "hours_remaining")


@query("SELECT circuit, n AS events_collected, CASE WHEN circuit < 'e' AND n >= 100 THEN 'labelling' ELSE 'calibrating' END AS next_state FROM (SELECT circuit, count(*) AS n FROM u WHERE NOT excluded GROUP BY circuit)")
def st01(spark, d):
    u = usage_events(spark, d)
    ends = F.when(F.col("circuit") < "e", stamp("2024-01-15 00:00:00")).otherwise(stamp("2024-02-15 00:00:00"))
    states = u.select("circuit").distinct().withColumns({"state": F.lit("calibrating"), "calibration_ends_at": ends, "minimum_events": F.lit(100), "completed_at": F.lit(None).cast("timestamp_ntz"), "paused": F.lit(False)})
    counts = u.where("not excluded").groupBy("circuit").agg(F.count("*").alias("collected"))
    return rules.training_step(states, counts, stamp(AS_OF)).select("circuit", "events_collected", "next_state")


LEAKS = """, s AS (SELECT circuit || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS test_id, ts, value, min(ts) OVER (PARTITION BY circuit, CAST(ts AS DATE)) AS started_at FROM r),
e AS (SELECT test_id, ts, CASE WHEN value - 20 > 90 THEN 4 WHEN 20 - value > 18 THEN 3 WHEN epoch_us(ts) - epoch_us(started_at) >= 36000000000 THEN 2 END AS r FROM s)
SELECT test_id, CAST(arg_min(r, ts) AS INTEGER) AS result, min(ts) AS ended_at FROM e WHERE r IS NOT NULL GROUP BY test_id"""


@query(LEAKS)
def st04(spark, d):
    own = readings(spark, d).withColumn("test_id", F.concat_ws("/", "circuit", F.to_date("ts").cast("string")))
    starts = own.groupBy("test_id").agg(F.min("ts").alias("started_at"))
    samples = own.join(starts, "test_id").select("test_id", "ts", "started_at", (F.col("value") / 5 + 0.0).alias("pressure"), F.lit(4.0).alias("baseline"), F.lit(36000).alias("duration_seconds"), F.lit(None).cast("string").alias("command"), F.lit(0.0).alias("rapid_drop_psi"))
    rise = samples.withColumn("pressure", F.when(F.col("pressure") > 22, 9.0).when(F.col("pressure") < 0.4, 0.5).otherwise(4.0))
    return rules.leak_tests(rise)


@query("SELECT CAST(n AS BIGINT) AS n, CASE n WHEN 0 THEN TIMESTAMP '2024-01-21 06:00:00' WHEN 1 THEN TIMESTAMP '2024-01-23 06:00:00' WHEN 2 THEN TIMESTAMP '2024-02-01 06:00:00' WHEN 3 THEN TIMESTAMP '2024-02-06 06:00:00' END AS next_run FROM range(0, 5) t(n)")
def st06(spark, d):
    kinds = [(0, "daily", None), (1, "weekly", None), (2, "fortnightly", "2024-01-18 06:00:00"), (3, "monthly", None), (4, "never", None)]
    rows = spark.createDataFrame(kinds, "n long, frequency string, last string").select("n", "frequency", F.lit(6).alias("hour"), F.lit(1).alias("weekday"), F.col("last").cast("timestamp_ntz").alias("last_run"))
    return rules.next_run(rows, stamp(AS_OF)).select("n", "next_run")


@query("SELECT circuit, round(coalesce(CASE WHEN circuit = 'click' THEN 0e0 END, CASE circuit WHEN 'view' THEN 3e0 WHEN 'error' THEN 1e0 ELSE 2e0 END), 2) AS effective_pressure_drop FROM (SELECT DISTINCT circuit FROM u)")
def st09(spark, d):
    none = F.lit(None).cast("double")
    own = usage_events(spark, d).select("circuit").distinct().withColumns({"preset": F.when(F.col("circuit") == "view", "low").when(F.col("circuit") == "error", "high").otherwise("medium"), "pressure_drop": F.when(F.col("circuit") == "click", 0.0), "min_duration": none, "score_alert": none, "score_shutoff": none})
    return rules.sensitivity(own).select("circuit", "effective_pressure_drop")


@query(f"SELECT circuit, CAST(greatest(0, floor((epoch_us(e) - epoch_us(TIMESTAMP '{AS_OF}')) / 60e6)) AS BIGINT) AS minutes, least(e + INTERVAL 30 MINUTE, s + INTERVAL 60 MINUTE) AS extended FROM (SELECT circuit, max(start_ts) AS s, max(start_ts) + INTERVAL 45 MINUTE AS e FROM u GROUP BY circuit)")
def st10(spark, d):
    own = usage_events(spark, d).groupBy("circuit").agg(F.max("start_ts").alias("s")).withColumn("e", F.expr("s + interval 45 minutes"))
    return own.select("circuit", rules.minutes_remaining(F.col("e"), stamp(AS_OF)).alias("minutes"), rules.extended_window(F.col("s"), F.col("e"), 30).alias("extended"))


PERSONS = "SELECT circuit, id, ts, sensor, CASE WHEN value < 2 THEN 'home' WHEN value < 5 THEN 'unknown' WHEN value < 20 THEN '' ELSE 'not_home' END AS state FROM r"


def persons(spark, d):
    """Each sensor as a person, whose place its reading says."""
    value = F.col("value")
    return readings(spark, d).withColumn("state", F.when(value < 2, "home").when(value < 5, "unknown").when(value < 20, "").otherwise("not_home"))


@query(f"SELECT place, CASE WHEN bool_and(state = 'not_home') FILTER (state <> '') THEN true WHEN bool_or(state = 'home') FILTER (state <> '') THEN false END AS away FROM (SELECT *, circuit || '/' || CAST(date_trunc('hour', ts) AS VARCHAR) AS place FROM ({PERSONS})) GROUP BY place")
def agg16_presence(spark, d):
    """Who is home, hour by hour of each circuit."""
    own = persons(spark, d).withColumn("place", F.concat_ws("/", "circuit", F.date_format("ts", "yyyy-MM-dd HH:00:00")))
    return rules.presence(own, key="place")


_LAST = ", ".join(f"last_value(CASE WHEN sensor = {i} AND state <> '' THEN state END IGNORE NULLS) OVER w" for i in range(8))


@query(f""", p AS ({PERSONS}), k AS (SELECT *, list_filter([{_LAST}], lambda s: s IS NOT NULL) AS known FROM p WINDOW w AS (PARTITION BY circuit ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN state = '' THEN NULL WHEN len(known) > 0 AND len(list_filter(known, lambda s: s <> 'not_home')) = 0 THEN true WHEN list_contains(known, 'home') THEN false END AS mode FROM k),
a AS (SELECT *, coalesce(last_value(mode IGNORE NULLS) OVER (PARTITION BY circuit ORDER BY ts, id ROWS UNBOUNDED PRECEDING), false) AS away FROM m)
SELECT id, circuit, away, away <> coalesce(lag(away) OVER (PARTITION BY circuit ORDER BY ts, id), false) AS toggled FROM a""")
def str08_away(spark, d):
    """The away mode of each circuit after each change of one of its eight persons."""
    own = persons(spark, d).withColumn("sensor", F.col("sensor").cast("string"))
    return rules.away_history(own, "circuit", "sensor", [str(i) for i in range(8)], ["ts", "id"]).select("id", "circuit", "away", "toggled")


@query("SELECT circuit, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(CAST(sum(duration_seconds) FILTER (duration_seconds > 0) AS BIGINT)) AS calibration_ends_at FROM u GROUP BY circuit")
def str09(spark, d):
    u = usage_events(spark, d)
    ends = u.select("circuit").distinct().withColumn("calibration_ends_at", stamp("2024-02-01 00:00:00"))
    return rules.calibration_end(ends, u.select("circuit", F.col("start_ts").alias("since"), F.col("end_ts").alias("until")))


@query("SELECT id, CASE WHEN value > 37.5 THEN 'instant_burst' WHEN flow > 25 THEN 'burst' WHEN sensor * 2 > 10 AND flow > 0 THEN 'rapid_drop' END AS fault_kind FROM (SELECT *, value / 2 AS flow FROM r)")
def st07_kinds(spark, d):
    own = readings(spark, d).select("id", F.col("value").alias("raw_flow"), (F.col("value") / 2).alias("flow"), (F.col("sensor") * 2).alias("drop_5s"))
    return rules.faults(own).select("id", "fault_kind")


@query("SELECT id, CASE WHEN a AND NOT b THEN 'open' WHEN b AND NOT a THEN 'closed' ELSE 'unknown' END AS state FROM (SELECT id, user_id % 2 = 0 AS a, user_id % 3 = 0 AS b FROM u)")
def st08(spark, d):
    return usage_events(spark, d).select("id", rules.valve_state(F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0).alias("state"))
