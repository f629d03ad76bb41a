"""Series, intervals, signal conditioning, sessions and clustering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions import scalars
from tidewatch.operators import clustering, intervals, maintenance, rollups, series, signal
from tidewatch.operators import relational as rel
from tidewatch.plans import sessions
from tidewatch.queries import AS_OF, query, settled
from tidewatch.sources.history import clusters, fixtures, readings, signals, usage_events
from tidewatch.streaming.detector import detect

ORDER = ["ts", "id"]
START = ["start_ts", "id"]
WINDOW_END = datetime(2024, 2, 15)
PART = "PARTITION BY circuit ORDER BY ts, id"


def micros(a, b):
    return f"(epoch_us({a}) - epoch_us({b})) / 1e6"


@query(f"SELECT id, circuit, round(avg(value) OVER w + 1e-9, 4) AS v, round(sum(value) OVER w, 3) AS s FROM (SELECT * FROM r) WINDOW w AS ({PART} ROWS UNBOUNDED PRECEDING)")
def agg15_readings(spark, d):
    own = series.running(readings(spark, d), "circuit", ORDER, {"s": ("sum", F.col("value")), "n": ("sum", F.lit(1))})
    return own.select("id", "circuit", settled(F.col("s") / F.col("n"), 4).alias("v"), F.round("s", 3).alias("s"))


@query("SELECT id, circuit, cluster_id, count(*) OVER w AS member_count, round(avg(avg_flow_lpm) OVER w + 1e-9, 4) AS mean_avg_flow_lpm, round(avg(duration_seconds) OVER w + 1e-9, 4) AS mean_duration_seconds FROM u WHERE cluster_id IS NOT NULL WINDOW w AS (PARTITION BY circuit, cluster_id ORDER BY start_ts, id ROWS UNBOUNDED PRECEDING)")
def agg15(spark, d):
    out = clustering.running_centroids(usage_events(spark, d), START, ["avg_flow_lpm", "duration_seconds"])
    return out.select("id", "circuit", "cluster_id", "member_count", settled("mean_avg_flow_lpm", 4).alias("mean_avg_flow_lpm"), settled("mean_duration_seconds", 4).alias("mean_duration_seconds"))


@query(f"SELECT circuit, CAST(ts AS DATE) AS day, round(coalesce(sum((value + f) / 2 * {micros('ts', 't')} / 60), 0e0), 3) AS litres FROM (SELECT *, lag(ts) OVER w AS t, lag(value) OVER w AS f FROM r WINDOW w AS ({PART})) GROUP BY ALL")
def agg17(spark, d):
    own = readings(spark, d).withColumn("day", F.to_date("ts"))
    return signal.integrated(own, "circuit", ORDER, "value", ["circuit", "day"]).withColumn("litres", F.round("litres", 3))


@query("SELECT circuit, date_trunc('hour', ts) AS hour_ts, round(avg(value) + 1e-9, 4) AS mean, max(value) AS top, round(coalesce(stddev_samp(value), 0e0) + 1e-9, 4) AS stdev FROM r GROUP BY ALL")
def agg12(spark, d):
    own = readings(spark, d).groupBy("circuit", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"))
    stats = own.agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    return stats.select("circuit", "hour_ts", settled("mean", 4).alias("mean"), "top", settled("stdev", 4).alias("stdev"))


@query(f"SELECT id, circuit, CASE WHEN g >= 0 AND g < 300 THEN round(g, 6) END AS gap FROM (SELECT id, circuit, {micros('lead(start_ts) OVER (PARTITION BY circuit ORDER BY start_ts, id)', 'end_ts')} AS g FROM u)")
def win02(spark, d):
    return sessions.with_gaps(usage_events(spark, d)).select("id", "circuit", F.round("seconds_to_next_event", 6).alias("gap"))


@query(f"SELECT id, circuit, CASE WHEN count(value) OVER w = 80 THEN round(avg(value) OVER w + 1e-9, 4) END AS baseline, coalesce(CASE WHEN count(value) OVER w = 80 THEN avg(value) OVER w END - value >= 20, false) AS is_drop FROM r WINDOW w AS ({PART} ROWS BETWEEN 199 PRECEDING AND 120 PRECEDING)")
def win03(spark, d):
    return signal.lagged_baseline(readings(spark, d), "circuit", ORDER, "value", threshold=20.0).select("id", "circuit", settled("baseline", 4).alias("baseline"), "is_drop")


@query(f"SELECT id, circuit, coalesce(count(value) OVER w = 5 AND avg(value) OVER w - value >= 30, false) AS is_composite FROM r WINDOW w AS ({PART} ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING)")
def win05(spark, d):
    out = signal.composite_drop(readings(spark, d), "circuit", ORDER, "value", threshold=20.0)
    return out.select("id", "circuit", F.coalesce("is_composite", F.lit(False)).alias("is_composite"))


@query(f"SELECT id, circuit, m AS moving_avg FROM (SELECT id, circuit, round(1e-9 + avg(value) OVER ({PART} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS m, row_number() OVER ({PART}) AS p FROM r) WHERE p % 5 = 0")
def win07(spark, d):
    return signal.moving_average(readings(spark, d), "circuit", ORDER, "value", 30, 5).select("id", "circuit", settled("moving_avg", 4).alias("moving_avg"))


@query("SELECT circuit, hour_ts, round(list_reduce(a, lambda x, y: 0.2e0 * y + 0.8e0 * x) + 1e-9, 4) AS last_ema FROM (SELECT circuit, date_trunc('hour', ts) AS hour_ts, list(value ORDER BY ts, id) AS a FROM r GROUP BY ALL)")
def win08(spark, d):
    own = readings(spark, d).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return signal.last_ema(own, ["circuit", "hour_ts"], ORDER, "value").withColumn("last_ema", settled("last_ema", 4))


@query("SELECT id, round(value * 2, 0) / 2 AS stepped FROM r")
def win09(spark, d):
    return readings(spark, d).select("id", scalars.half_steps(F.col("value")).alias("stepped"))


@query(f"""SELECT id, circuit, coalesce(ok AND n = 11 AND old_ok AND old_run = run AND old - value > 10 AND {micros('ts', 't0')} >= 30, false) AS is_rapid FROM (
 SELECT *, first_value(value) OVER f AS old, first_value(ok) OVER f AS old_ok, first_value(run) OVER f AS old_run, count(*) OVER f AS n, min(ts) OVER (PARTITION BY circuit) AS t0 FROM (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, sensor <> 3 AS ok FROM r)) WINDOW f AS ({PART} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))""")
def win10(spark, d):
    return signal.rapid_drop(readings(spark, d), "circuit", ORDER, "value", F.col("sensor") != 3).select("id", "circuit", "is_rapid")


@query(f"""SELECT circuit, min(ts) AS on_ts, max(ts) + INTERVAL 600 SECOND AS off_ts, count(*) AS pulses FROM (SELECT *, sum(o) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT *, CASE WHEN {micros('ts', f'lag(ts) OVER ({PART})')} <= 600 THEN 0 ELSE 1 END AS o FROM r WHERE value >= 20)) GROUP BY circuit, run""")
def win11(spark, d):
    return signal.debounced(readings(spark, d), "circuit", ORDER, F.col("value") >= 20, 600.0)


RUNS = f"runs AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, value BETWEEN 2 AND 60 AS inside FROM r))"


@query(f", {RUNS} SELECT circuit, started_at, alert_at FROM (SELECT circuit, min(ts) AS started_at, list(ts ORDER BY ts, id)[4] AS alert_at, count(*) AS n FROM runs WHERE inside GROUP BY circuit, run) WHERE n >= 4")
def win12(spark, d):
    return signal.run_alerts(readings(spark, d), "circuit", ORDER, F.col("value").between(2, 60), 4)


@query(f", {RUNS} SELECT circuit, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM runs WHERE inside GROUP BY circuit, run HAVING {micros('max(ts)', 'min(ts)')} >= 900")
def win13(spark, d):
    return signal.sustained_runs(readings(spark, d), "circuit", ORDER, F.col("value").between(2, 60), 900.0)


Z = lambda c: f"round(CASE WHEN var_pop({c}) OVER w > 1e-9 THEN ({c} - avg({c}) OVER w) / sqrt(var_pop({c}) OVER w) ELSE 0e0 END, 3) AS z_{c}"


@query(f"SELECT id, circuit, {Z('duration_seconds')}, {Z('avg_flow_lpm')} FROM u WINDOW w AS (PARTITION BY circuit ORDER BY start_ts, id ROWS UNBOUNDED PRECEDING)")
def win15(spark, d):
    out = clustering.standardised(usage_events(spark, d), "circuit", START, ["duration_seconds", "avg_flow_lpm"])
    return out.select("id", "circuit", F.round("z_duration_seconds", 3).alias("z_duration_seconds"), F.round("z_avg_flow_lpm", 3).alias("z_avg_flow_lpm"))


@query("SELECT id, circuit, n AS member_count, n = 1 OR n % 10 = 0 AS suggest FROM (SELECT id, circuit, row_number() OVER (PARTITION BY circuit, cluster_id ORDER BY start_ts, id) AS n FROM u WHERE cluster_id IS NOT NULL)")
def win16(spark, d):
    return clustering.running_centroids(usage_events(spark, d), START, []).select("id", "circuit", "member_count", "suggest")


DAY_LISTS = "days AS (SELECT circuit, CAST(ts AS DATE) AS day, list(value ORDER BY ts, id) AS a FROM r GROUP BY ALL)"


@query(f""", {DAY_LISTS}, c AS (SELECT *, len(a) AS n, greatest(1, len(a) // 5) AS cut FROM days), s AS (SELECT circuit, day, n, a[cut + 1 : n - cut] AS x FROM c), t AS (SELECT *, len(x) AS m, list_avg(x) AS mean, greatest(1, len(x) // 3) AS k FROM s)
SELECT circuit, day, CASE WHEN n < 10 OR m < 6 OR mean <= 0 THEN 'unknown' WHEN coalesce(list_stddev_samp(x), 0e0) / mean >= 0.55e0 THEN 'pulsed' WHEN (list_avg(x[m - k + 1 :]) - list_avg(x[: k])) / mean > 0.15e0 THEN 'rising' WHEN (list_avg(x[m - k + 1 :]) - list_avg(x[: k])) / mean < -0.15e0 THEN 'falling' ELSE 'steady' END AS shape FROM t""")
def win17(spark, d):
    return signal.curve_shapes(readings(spark, d).withColumn("day", F.to_date("ts")), ["circuit", "day"], ORDER, "value")


@query(f""", {DAY_LISTS}, k AS (SELECT circuit, day, a, len(a) AS n, least(4, len(a)) AS k FROM days), b AS (SELECT *, CAST(unnest(range(0, k)) AS INTEGER) AS bin FROM k),
l AS (SELECT *, CAST(round_even(bin * n / k, 0) AS BIGINT) AS lo, CAST(round_even((bin + 1) * n / k, 0) AS BIGINT) AS hi FROM b)
SELECT circuit, day, bin, round(list_avg(a[lo + 1 : greatest(hi, lo + 1)]) + 1e-9, 4) AS mean FROM l""")
def win18(spark, d):
    out = signal.resampled(readings(spark, d).withColumn("day", F.to_date("ts")), ["circuit", "day"], ORDER, "value", 4)
    return out.withColumn("mean", settled("mean", 4))


@query(f"SELECT id, circuit FROM (SELECT id, circuit, ts, row_number() OVER ({PART}) AS p, min(ts) OVER (PARTITION BY circuit) AS t0 FROM r) WHERE {micros('ts', 't0')} <= 86400 OR p % 5 = 0")
def win21(spark, d):
    first = readings(spark, d).groupBy("circuit").agg(F.min("ts").alias("started"))
    return signal.thinned(readings(spark, d).join(first, "circuit"), "circuit", ORDER, "started", 86400.0, 5).select("id", "circuit")


def island_sql(gap):
    return f"""SELECT circuit, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_merged FROM (SELECT *, sum(o) OVER (PARTITION BY circuit ORDER BY start_ts, id ROWS UNBOUNDED PRECEDING) AS i FROM (
 SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY circuit ORDER BY start_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL {gap} SECOND THEN 0 ELSE 1 END AS o FROM u)) GROUP BY circuit, i"""


@query(island_sql(15))
def set02(spark, d):
    return intervals.coalesce_intervals(usage_events(spark, d), "circuit", "start_ts", "end_ts", "id", 15.0)


@query(island_sql(900))
def set02_wide(spark, d):
    return intervals.coalesce_intervals(usage_events(spark, d), "circuit", "start_ts", "end_ts", "id", 900.0)


@query("SELECT circuit, start_ts FROM u WHERE cluster_id = 1 UNION ALL SELECT circuit, start_ts FROM u WHERE triggered_alert")
def set01(spark, d):
    u = usage_events(spark, d)
    return u.where("cluster_id = 1").select("circuit", "start_ts").unionByName(u.where("triggered_alert").select("circuit", "start_ts"))


NEAR = "SELECT id, circuit FROM u WHERE {n} EXISTS (SELECT 1 FROM u o WHERE o.anomaly_score >= 0.9 AND o.circuit = u.circuit AND abs(CAST(floor(epoch(o.start_ts)) AS BIGINT) - CAST(floor(epoch(u.start_ts)) AS BIGINT)) <= 300)"


@query(NEAR.format(n=""))
def flt04(spark, d):
    """All events against the anomalous ones."""
    u = usage_events(spark, d)
    return intervals.near(u, u.where("anomaly_score >= 0.9"), "circuit", "start_ts", 300.0).select("id", "circuit")


@query(NEAR.format(n="NOT"))
def set04(spark, d):
    u = usage_events(spark, d)
    return intervals.near(u, u.where("anomaly_score >= 0.9"), "circuit", "start_ts", 300.0, anti=True).select("id", "circuit")


SPANS = "spans AS (SELECT circuit, start_ts AS started_at, start_ts + INTERVAL 2 HOUR AS ends_at FROM u WHERE anomaly_score >= 0.97)"


def windows(u):
    return u.where("anomaly_score >= 0.97").select("circuit", F.col("start_ts").alias("started_at"), (F.col("start_ts") + F.expr("interval 2 hours")).alias("ends_at"))


@query(f", {SPANS} SELECT id, circuit FROM u WHERE EXISTS (SELECT 1 FROM spans s WHERE s.circuit = u.circuit AND u.start_ts BETWEEN s.started_at AND s.ends_at)")
def flt05(spark, d):
    u = usage_events(spark, d)
    return intervals.in_interval(u, windows(u), "circuit", "start_ts", "started_at", "ends_at").select("id", "circuit")


@query(f", {SPANS} SELECT id, circuit FROM u WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.circuit = u.circuit AND u.start_ts BETWEEN s.started_at AND s.ends_at)")
def flt07(spark, d):
    u = usage_events(spark, d)
    return intervals.in_interval(u, windows(u), "circuit", "start_ts", "started_at", "ends_at", anti=True).select("id", "circuit")


@query("SELECT u.id, u.circuit, count(*) AS n, round(avg(r.value) FILTER (r.ts >= u.start_ts) + 1e-9, 4) AS inside, round(avg(r.value) FILTER (r.ts <= u.start_ts) + 1e-9, 4) AS baseline FROM u JOIN r ON r.circuit = u.circuit AND r.ts BETWEEN u.start_ts - INTERVAL 1800 SECOND AND u.end_ts GROUP BY ALL")
def jn08(spark, d):
    u = usage_events(spark, d).select("id", "circuit", "start_ts", "end_ts")
    out = intervals.range_means(u, readings(spark, d).select("circuit", "ts", "value"), "circuit", "id", "start_ts", "end_ts", "ts", "value", 1800.0)
    return out.select("id", "circuit", "n", settled("inside", 4).alias("inside"), settled("baseline", 4).alias("baseline"))


@query(f", {RUNS}, s AS (SELECT circuit, min(ts) AS started_at, max(ts) AS ended_at FROM runs WHERE inside GROUP BY circuit, run) SELECT s.circuit, s.started_at, r.id FROM s JOIN r ON r.circuit = s.circuit AND r.ts BETWEEN s.started_at AND s.ended_at")
def jn08_runs(spark, d):
    spans = signal.sustained_runs(readings(spark, d), "circuit", ORDER, F.col("value").between(2, 60), 0.0)
    out = intervals.range_join(spans, readings(spark, d), "circuit", "started_at", "ended_at", "ts")
    return out.select("circuit", "started_at", F.col("point.id").alias("id"))


@query(f"SELECT id, circuit, fault FROM (SELECT id, circuit, coalesce(last_value(CASE WHEN value > 60 THEN true WHEN sensor = 5 THEN false END IGNORE NULLS) OVER ({PART} ROWS UNBOUNDED PRECEDING), false) AS fault FROM r)")
def st07(spark, d):
    return signal.latched(readings(spark, d), "circuit", ORDER, F.col("value") > 60, F.col("sensor") == 5).select("id", "circuit", "fault")


@query(f"SELECT id, circuit, before, sensor FROM (SELECT id, circuit, sensor, lag(sensor) OVER ({PART}) AS before FROM r) WHERE before IS DISTINCT FROM sensor")
def str08(spark, d):
    return signal.edges(readings(spark, d), "circuit", ORDER, "sensor").select("id", "circuit", "before", "sensor")


FEATURES_SQL = "SELECT id, circuit, round(sin(hour(start_ts) * pi() / 12), 4) AS hour_sin, round(cos(hour(start_ts) * pi() / 12), 4) AS hour_cos, round(ln(duration_seconds + 1), 4) AS duration_log, duration_seconds <= 0 AS features_missing FROM u"


@query(FEATURES_SQL)
def clu01(spark, d):
    out = clustering.feature_columns(usage_events(spark, d))
    return out.select("id", "circuit", *[F.round(c, 4).alias(c) for c in ("hour_sin", "hour_cos", "duration_log")], "features_missing")


GATE = """, t AS (SELECT u.*, f.fixture_type, c.avg_flow, c.avg_duration, c.avg_volume FROM u LEFT JOIN (SELECT circuit, cluster_id, avg(avg_flow_lpm) AS avg_flow, avg(duration_seconds) AS avg_duration, avg(volume_litres) AS avg_volume FROM u WHERE cluster_id IS NOT NULL GROUP BY ALL) c USING (circuit, cluster_id)
 LEFT JOIN clusters k USING (circuit, cluster_id) LEFT JOIN (SELECT * FROM fixtures WHERE confirmed AND fixture_type IS NOT NULL) f ON f.fixture_id = k.fixture_id),
 g AS (SELECT id, circuit, fixture_type, CASE fixture_type WHEN 'toilet' THEN sqrt(2 * ((avg_flow_lpm - avg_flow) / 50) ^ 2 + 3 * ((duration_seconds - avg_duration) / 50) ^ 2 + 3 * ((volume_litres - avg_volume) / 50) ^ 2) WHEN 'shower' THEN sqrt(3 * ((avg_flow_lpm - avg_flow) / 50) ^ 2) END AS dist FROM t)
 SELECT id, circuit, round(dist, 4) AS gate_distance, coalesce(dist <= CASE fixture_type WHEN 'toilet' THEN 0.6 ELSE 2.5 END, true) AS accepted FROM g"""


@query(GATE)
def clu05(spark, d):
    u = usage_events(spark, d)
    types = rel.type_cache(clusters(u), fixtures(spark))
    own = u.join(rollups.cluster_stats(u).withColumnRenamed("avg_flow", "mean_flow"), ["circuit", "cluster_id"], "left").join(types, ["circuit", "cluster_id"], "left")
    names = {"avg_flow_lpm": "mean_flow", "duration_seconds": "avg_duration", "volume_litres": "avg_volume"}
    out = clustering.gate(own, "fixture_type", {f: F.col(f) / 50 for f in names}, {f: F.col(c) / 50 for f, c in names.items()})
    return out.select("id", "circuit", F.round("gate_distance", 4).alias("gate_distance"), "accepted")


@query("SELECT id, round(exp(-pressure_delta_psi / 1.5), 4) AS confidence, round(1 - exp(-pressure_delta_psi / 1.5), 3) AS score FROM u")
def clu06(spark, d):
    sure = clustering.match_confidence(F.col("pressure_delta_psi"))
    return usage_events(spark, d).select("id", F.round(sure, 4).alias("confidence"), scalars.anomaly_score(sure, F.lit(None).cast("string")).alias("score"))


@query(f"""SELECT circuit, from_cluster, to_cluster, count(*) AS count, round(avg(g) + 1e-9, 3) AS mean_gap, max(start_ts) AS last_seen FROM (
 SELECT circuit, cluster_id AS to_cluster, start_ts, lag(cluster_id) OVER w AS from_cluster, {micros('start_ts', 'lag(end_ts) OVER w')} AS g FROM u WINDOW w AS (PARTITION BY circuit ORDER BY start_ts, id))
 WHERE g >= 0 AND g < 300 AND from_cluster IS NOT NULL AND to_cluster IS NOT NULL GROUP BY ALL""")
def clu09(spark, d):
    own = series.previous(usage_events(spark, d), "circuit", START, {"from_cluster": "cluster_id", "before": "end_ts"})
    gap = series.seconds(F.col("start_ts")) - series.seconds(F.col("before"))
    pairs = own.where((gap >= 0) & (gap < 300) & F.col("from_cluster").isNotNull() & F.col("cluster_id").isNotNull())
    pairs = pairs.select("circuit", "from_cluster", F.col("cluster_id").alias("to_cluster"), gap.alias("gap_seconds"), F.col("start_ts").alias("seen_at"))
    return maintenance.transitions(pairs).withColumn("mean_gap", settled("mean_gap", 3))


def rules_sql():
    parts = ["WHEN circuit = 'signup' AND d >= 300 AND f >= 5 THEN 'irrigation_zone'", "WHEN circuit = 'signup' AND d BETWEEN 30 AND 300 AND f >= 3 THEN 'hose_bib'"]
    for name, _, v, s, f, t in clustering.RULES:
        flow = f" AND f BETWEEN {f[0]} AND {f[1]}" if f else ""
        transient = f" AND t > {t}" if t is not None else ""
        parts.append(f"WHEN circuit <> 'signup' AND v BETWEEN {v[0]} AND {v[1]} AND d BETWEEN {s[0]} AND {s[1]}{flow}{transient} THEN '{name}'")
    return f"SELECT id, circuit, CASE {' '.join(parts)} END AS suggested_type FROM (SELECT id, circuit, volume_litres AS v, duration_seconds AS d, avg_flow_lpm AS f, CASE WHEN has_pressure_transient THEN 1 ELSE 0 END AS t FROM u)"


@query(rules_sql())
def clu12(spark, d):
    own = usage_events(spark, d).withColumn("circuit_type", F.when(F.col("circuit") == "signup", "zone").otherwise("fixture"))
    return clustering.classified(own).select("id", "circuit", "suggested_type")


SCALED = [f"z_{n}" for n in clustering.FEATURES]


def scaled(events):
    """events with the nine features, each standardised by its circuit's running mean and deviation."""
    own = clustering.feature_columns(events).withColumns({n: F.col(n).cast("double") for n in clustering.FEATURES})
    return clustering.standardised(own, "circuit", START, clustering.FEATURES)


@query()
def clu03(spark, d):
    return clustering.learn_clusters(scaled(usage_events(spark, d)), SCALED)


@query()
def clu10(spark, d):
    """The learner rebuilt from the matched events of the last 60 days, from an empty state, and its groups mapped to the stored clusters."""
    u = usage_events(spark, d).where(F.col("cluster_id").isNotNull() & (F.col("start_ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 60 days")))
    own = scaled(u)
    groups = clustering.learn_clusters(own, SCALED).where("learned_id is not null").join(own.select("circuit", "id", *SCALED), ["circuit", "id"])
    means = [F.avg(n).alias(n) for n in SCALED]
    stored = own.groupBy("circuit", "cluster_id").agg(*means).join(clusters(u).select("circuit", "cluster_id", "suggested_type"), ["circuit", "cluster_id"])
    return clustering.remapped(groups.groupBy("circuit", "learned_id").agg(*means), stored, SCALED)


@query()
def clu11(spark, d):
    """The unmatched events that count for training, grouped in order of their start."""
    u = usage_events(spark, d).where("cluster_id is null and not excluded").withColumn("end_ts", F.col("start_ts"))
    return clustering.learn_clusters(scaled(u), SCALED)


@query()
def str01(spark, d):
    """Events by all three triggers: pressure, flow and onset, with gaps that empty the buffer."""
    return detect(signals(spark, d), min_seconds=3.0)


SIGNALS = """, sg AS (SELECT circuit, id, ts, value, CASE WHEN sensor < 4 THEN 'flow' WHEN sensor < 6 THEN 'pressure' WHEN sensor = 6 THEN 'onset' WHEN id % 2 = 0 THEN 'volume' ELSE 'reset' END AS role FROM r),
x AS (SELECT *, CASE role WHEN 'flow' THEN value >= 20 ELSE value >= 25 END AS inside FROM sg WHERE role IN ('flow', 'onset')),
y AS (SELECT *, count(*) FILTER (NOT inside) OVER (PARTITION BY circuit, role ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM x),
z AS (SELECT circuit, role, CASE WHEN inside THEN run ELSE run - 1 END AS g, min(ts) FILTER (inside) AS s, min(ts) FILTER (NOT inside) AS e FROM y GROUP BY ALL),
p AS (SELECT DISTINCT circuit, s, coalesce(e, TIMESTAMP '2024-02-15 00:00:00') AS e FROM z WHERE s IS NOT NULL AND (e IS NOT NULL OR s < TIMESTAMP '2024-02-15 00:00:00')),
i AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY circuit ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 15 SECOND THEN 0 ELSE 1 END AS o FROM p),
m AS (SELECT circuit, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY circuit ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM i) GROUP BY circuit, n HAVING epoch_us(max(e)) - epoch_us(min(s)) >= 3000000),
f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.triggered_alert AND u.circuit = m.circuit AND abs(CAST(floor(epoch(u.start_ts)) AS BIGINT) - CAST(floor(epoch(m.s)) AS BIGINT)) <= 30)),
j AS (SELECT f.circuit, f.s, f.e, sg.ts, sg.id, sg.role, CASE sg.role WHEN 'flow' THEN CASE WHEN value > 200 OR value < 0.01 THEN 0e0 ELSE value END WHEN 'pressure' THEN CASE WHEN value < 0 OR value > 500 THEN 0e0 ELSE value END ELSE value END AS v
 FROM f JOIN sg ON sg.circuit = f.circuit AND sg.role IN ('flow', 'pressure', 'volume') AND sg.ts BETWEEN f.s - INTERVAL 30 SECOND AND f.e),
a AS (SELECT circuit, s, e, avg(v) FILTER (role = 'flow' AND ts >= s) AS avg_flow, max(v) FILTER (role = 'flow' AND ts >= s) AS peak, count(*) FILTER (role = 'flow' AND ts >= s) AS n_flow, avg(v) FILTER (role = 'pressure' AND ts <= s) AS pre,
 min(v) FILTER (role = 'pressure' AND ts >= s) AS low, list(v ORDER BY ts, id) FILTER (role = 'pressure' AND ts >= s) AS three, list(v ORDER BY ts, id) FILTER (role = 'volume' AND ts >= s) AS meter FROM j GROUP BY ALL),
b AS (SELECT *, coalesce(pre, list_avg(three[1:3]), 0e0) AS base FROM a WHERE peak >= 20),
c AS (SELECT *, coalesce(low, base) AS least, greatest(0e0, base - coalesce(low, base)) AS fall, meter[-1] - meter[1] AS metered FROM b)
SELECT circuit, s AS start_ts, e AS end_ts, 'flow' AS start_trigger, low IS NOT NULL AND fall >= 0.8 AS has_pressure_transient, round(base + 1e-9, 2) AS pre_event_pressure_psi, round(least + 1e-9, 2) AS min_pressure_psi, round(fall + 1e-9, 2) AS pressure_delta_psi,
 round(avg_flow + 1e-9, 4) AS avg_flow_lpm, peak AS peak_flow_lpm, n_flow, CASE WHEN len(meter) >= 2 AND metered > 0 AND metered < 10000 THEN round(metered + 1e-9, 3) END AS volume_litres_measured FROM c"""


@query(SIGNALS)
def str02(spark, d):
    """Periods of flow (here of 20 and more) and of the onset signal united, those of stored events (here the ones with an alert) left out."""
    out = sessions.reconstructed_events(signals(spark, d), usage_events(spark, d).where("triggered_alert"), window_end=WINDOW_END, least_flow=20.0)
    return out.withColumn("avg_flow_lpm", settled("avg_flow_lpm", 4))
