"""Roll-ups, joins, lookups and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import relational as rel
from tidewatch.operators import rollups
from tidewatch.operators.intervals import as_of
from tidewatch.queries import AS_OF, query, settled
from tidewatch.sources.history import clusters, fixtures, readings, table, usage_events


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


DAILY = "circuit, CAST(start_ts AS DATE) AS day"
DAYS = "days AS (SELECT circuit, CAST(start_ts AS DATE) AS day, sum(volume_litres) AS total_volume FROM u GROUP BY ALL)"
HOURS = "hours AS (SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, sum(volume_litres) AS volume FROM u GROUP BY ALL)"


def rounded(df, *names):
    return df.withColumns({n: settled(n, 4) for n in names})


def days(events):
    return events.groupBy("circuit", F.to_date("start_ts").alias("day")).agg(F.sum("volume_litres").alias("total_volume"))


def circuits(events):
    return events.select("circuit").distinct()


SUMMARY = """SELECT circuit, CAST(start_ts AS DATE) AS day, count(*) AS event_count, round(sum(volume_litres) + 1e-9, 4) AS total_volume, round(avg(avg_flow_lpm) + 1e-9, 4) AS avg_flow, max(peak_flow_lpm) AS peak_flow,
 round(avg(pre_event_pressure_psi) + 1e-9, 4) AS avg_pressure, min(min_pressure_psi) AS min_pressure, count(*) FILTER (anomaly_score > 0.6) AS anomaly_count, count(*) FILTER (triggered_alert) AS alert_count FROM u GROUP BY ALL"""
TOP = """, c AS (SELECT circuit, CAST(start_ts AS DATE) AS day, fixture_id, count(*) AS n FROM u WHERE fixture_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY circuit, day ORDER BY n DESC, fixture_id) AS p FROM c),
t AS (SELECT circuit, day, '[' || string_agg('{"fixture_id":"' || fixture_id || '","count":' || n || '}', ',' ORDER BY p) || ']' AS breakdown, max(fixture_id) FILTER (p = 1) AS top_fixture_id, max(n) AS top_count FROM k WHERE p <= 5 GROUP BY ALL)"""


@query(SUMMARY)
def agg01(spark, d):
    return rounded(rollups.daily_summary(usage_events(spark, d)), "total_volume", "avg_flow", "avg_pressure")


@query(f"{TOP}, s AS ({SUMMARY}) SELECT s.*, breakdown, top_fixture_id, top_count FROM s LEFT JOIN t USING (circuit, day)")
def agg02(spark, d):
    return rounded(rollups.daily_report(usage_events(spark, d)), "total_volume", "avg_flow", "avg_pressure")


@query("SELECT circuit, fixture_id, CAST(start_ts AS DATE) AS day, count(*) AS event_count, round(sum(volume_litres) + 1e-9, 4) AS total_volume, round(avg(duration_seconds) + 1e-9, 4) AS avg_duration, round(avg(avg_flow_lpm) + 1e-9, 4) AS avg_flow FROM u WHERE fixture_id IS NOT NULL GROUP BY ALL")
def agg03(spark, d):
    return rounded(rollups.fixture_days(usage_events(spark, d)), "total_volume", "avg_duration", "avg_flow")


VOLUME = "SELECT circuit, round(coalesce(sum(volume_litres) FILTER (CAST(start_ts AS DATE) >= CAST(TIMESTAMP '{t}' AS DATE) - {n} AND start_ts <= TIMESTAMP '{t}'), 0e0), 1) AS volume FROM u GROUP BY circuit"


@query(VOLUME.format(t=AS_OF, n=0))
def agg04(spark, d):
    u = usage_events(spark, d)
    return rollups.volume_since(u, circuits(u), now(), 0)


@query(VOLUME.format(t=AS_OF, n=7))
def agg05(spark, d):
    u = usage_events(spark, d)
    return rollups.volume_since(u, circuits(u), now(), 7)


@query(f", {HOURS} SELECT circuit, CAST(hour_ts AS DATE) AS day, round(sum(volume) + 1e-9, 4) AS volume FROM hours GROUP BY ALL")
def agg06(spark, d):
    hours = rollups.hourly_volume(usage_events(spark, d))
    return rounded(hours.groupBy("circuit", F.to_date("hour_ts").alias("day")).agg(F.sum("volume").alias("volume")), "volume")


@query(f", {DAYS} SELECT circuit, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS dom, round(sum(total_volume), 3) AS volume FROM days GROUP BY ROLLUP (circuit, year(day), month(day), day(day))")
def agg07(spark, d):
    return rollups.calendar_rollup(days(usage_events(spark, d))).withColumn("volume", F.round("volume", 3))


@query("SELECT circuit, cluster_id, count(*) AS event_count, round(avg(volume_litres) + 1e-9, 4) AS avg_volume, round(avg(duration_seconds) + 1e-9, 4) AS avg_duration, round(avg(avg_flow_lpm) + 1e-9, 4) AS avg_flow, max(start_ts) AS last_seen FROM u WHERE cluster_id IS NOT NULL GROUP BY ALL")
def agg08(spark, d):
    return rounded(rollups.cluster_stats(usage_events(spark, d)), "avg_volume", "avg_duration", "avg_flow")


PROFILE = f"{HOURS}, profile AS (SELECT circuit, CAST(hour(hour_ts) AS INTEGER) AS hr, avg(volume) AS avg_volume, count(*) AS n FROM hours GROUP BY ALL HAVING count(*) >= 7)"


@query(f", {PROFILE} SELECT circuit, hr, round(avg_volume + 1e-9, 4) AS avg_volume, n FROM profile")
def agg09(spark, d):
    return rounded(rollups.hour_profile(rollups.hourly_volume(usage_events(spark, d))), "avg_volume")


@query("""SELECT e.circuit, c.cluster_count, round(e.matched * 100e0 / e.n, 4) AS coverage, e.n - e.matched AS unmatched, round(c.avg_confidence + 1e-9, 4) AS avg_confidence
FROM (SELECT circuit, count(*) AS n, count(cluster_id) AS matched FROM u GROUP BY circuit) e LEFT JOIN (SELECT circuit, count(*) FILTER (member_count > 0) AS cluster_count, avg(suggested_confidence) AS avg_confidence FROM clusters GROUP BY circuit) c USING (circuit)""")
def agg10(spark, d):
    u = usage_events(spark, d)
    return rounded(rollups.quality_metrics(u, clusters(u)), "avg_confidence")


@query("SELECT circuit, max(start_ts) AS last_start, coalesce(max(id), -1) + 1 AS next_id FROM u GROUP BY circuit")
def agg11(spark, d):
    return usage_events(spark, d).groupBy("circuit").agg(F.max("start_ts").alias("last_start"), (F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("next_id"))


@query("SELECT circuit, hour_ts, CASE WHEN n >= 2 AND d > 0 AND d < 10000 THEN round(d, 3) END AS delta FROM (SELECT circuit, date_trunc('hour', ts) AS hour_ts, arg_max(value, (ts, id)) - arg_min(value, (ts, id)) AS d, count(*) AS n FROM r GROUP BY ALL)")
def agg13(spark, d):
    own = readings(spark, d).withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rollups.counter_delta(own, ["circuit", "hour_ts"], "ts", "value")


@query("SELECT circuit, bool_or(has_pressure_transient) AS any_transient, bool_and(excluded) AS all_excluded, count(*) FILTER (excluded) AS n_excluded FROM u GROUP BY circuit")
def agg16(spark, d):
    return usage_events(spark, d).groupBy("circuit").agg(F.bool_or("has_pressure_transient").alias("any_transient"), F.bool_and("excluded").alias("all_excluded"), F.count_if(F.col("excluded")).alias("n_excluded"))


NAMES = "SELECT u.id, u.circuit, u.cluster_id, c.fixture_id AS cluster_fixture, f.fixture_name, f.confirmed, coalesce(f.fixture_name, c.suggested_type, 'Cluster ' || u.cluster_id, '—') AS display_name FROM u LEFT JOIN clusters c ON u.circuit = c.circuit AND u.cluster_id = c.cluster_id LEFT JOIN fixtures f ON c.fixture_id = f.fixture_id"


@query(NAMES)
def jn01(spark, d):
    u = usage_events(spark, d)
    return rel.named_events(u, clusters(u), fixtures(spark)).select("id", "circuit", "cluster_id", "cluster_fixture", "fixture_name", "confirmed", "display_name")


@query("SELECT c.circuit, c.cluster_id, c.member_count, c.fixture_id, f.fixture_name, f.fixture_type, f.confirmed FROM clusters c LEFT JOIN fixtures f ON c.fixture_id = f.fixture_id")
def jn02(spark, d):
    u = usage_events(spark, d)
    return rel.named_clusters(clusters(u), fixtures(spark)).select("circuit", "cluster_id", "member_count", "fixture_id", "fixture_name", "fixture_type", "confirmed")


@query("SELECT c.circuit, c.cluster_id, f.fixture_type FROM clusters c JOIN fixtures f ON c.fixture_id = f.fixture_id WHERE f.confirmed AND f.fixture_type IS NOT NULL")
def jn03(spark, d):
    u = usage_events(spark, d)
    return rel.type_cache(clusters(u), fixtures(spark))


STORED = "stored AS (SELECT circuit, day, day + CASE WHEN dayofmonth(day) % 3 = 0 THEN 0 ELSE 1 END AS computed_at FROM (SELECT DISTINCT circuit, CAST(start_ts AS DATE) AS day FROM u) WHERE dayofmonth(day) % 4 <> 0)"


def stored_summaries(u):
    """Summaries of most days; some were computed too early."""
    own = u.select("circuit", F.to_date("start_ts").alias("day")).distinct().where(F.dayofmonth("day") % 4 != 0)
    return own.withColumn("computed_at", F.date_add("day", F.when(F.dayofmonth("day") % 3 == 0, 0).otherwise(1)))


@query(f", {STORED} SELECT DISTINCT u.circuit, CAST(u.start_ts AS DATE) AS day FROM u LEFT JOIN stored s ON s.circuit = u.circuit AND s.day = CAST(u.start_ts AS DATE) WHERE s.day IS NULL OR s.computed_at < s.day + 1")
def jn04(spark, d):
    u = usage_events(spark, d)
    return rel.days_to_summarise(u, stored_summaries(u))


@query("SELECT f.fixture_id, f.fixture_name, x.n, round(x.v, 4) AS volume FROM fixtures f LEFT JOIN (SELECT fixture_id, count(*) AS n, sum(volume_litres) AS v FROM u WHERE CAST(start_ts AS DATE) = DATE '2024-01-20' GROUP BY ALL) x USING (fixture_id)")
def jn05(spark, d):
    today = usage_events(spark, d).where(F.to_date("start_ts") == F.lit("2024-01-20").cast("date")).groupBy("fixture_id").agg(F.count("*").alias("n"), F.round(F.sum("volume_litres"), 4).alias("volume"))
    return fixtures(spark).join(today, "fixture_id", "left").select("fixture_id", "fixture_name", "n", "volume")


@query("SELECT DISTINCT circuit, fixture_id, CAST(start_ts AS DATE) AS day FROM u WHERE fixture_id IS NOT NULL AND NOT (dayofmonth(start_ts) <= 10 AND fixture_id <> 'f3')")
def jn06(spark, d):
    u = usage_events(spark, d).withColumn("day", F.to_date("start_ts"))
    stored = u.where((F.dayofmonth("day") <= 10) & (F.col("fixture_id") != "f3")).select("circuit", "fixture_id", "day").distinct()
    return rel.missing_keys(u, stored, ["circuit", "fixture_id", "day"])


@query("SELECT c.circuit, c.cluster_id, c.suggested_type, s.event_count, round(s.avg_volume, 4) AS avg_volume FROM clusters c LEFT JOIN (SELECT circuit, cluster_id, count(*) AS event_count, avg(volume_litres) AS avg_volume FROM u GROUP BY ALL) s USING (circuit, cluster_id)")
def jn07(spark, d):
    u = usage_events(spark, d)
    own = rollups.cluster_stats(u).select("circuit", "cluster_id", "event_count", F.round("avg_volume", 4).alias("avg_volume"))
    return clusters(u).select("circuit", "cluster_id", "suggested_type").join(own, ["circuit", "cluster_id"], "left")


@query(", s AS (SELECT circuit, ts, id, value FROM r WHERE sensor = 0) SELECT u.id, u.circuit, (SELECT arg_max(s.value, (s.ts, s.id)) FROM s WHERE s.circuit = u.circuit AND s.ts <= u.start_ts) AS valve FROM u")
def jn09(spark, d):
    states = readings(spark, d).where("sensor = 0").select("circuit", "ts", "id", "value")
    return as_of(usage_events(spark, d).select("circuit", "start_ts", "id"), states, "circuit", "start_ts", "id", "ts", "value", "valve").select("id", "circuit", "valve")


@query("""SELECT a.id, a.circuit, CASE WHEN g >= 0 AND g < 300 THEN round(g, 6) END AS gap, CASE WHEN g >= 0 AND g < 300 THEN p.cluster_id END AS prev_cluster_id
FROM (SELECT u.id, u.circuit, u.start_ts, (SELECT arg_max(b.id, (b.end_ts, b.id)) FROM u b WHERE b.circuit = u.circuit AND b.end_ts < u.start_ts) AS prev FROM u) a
LEFT JOIN u p ON p.id = a.prev LEFT JOIN LATERAL (SELECT (epoch_us(a.start_ts) - epoch_us(p.end_ts)) / 1e6 AS g) ON true""")
def jn10(spark, d):
    out = rel.previous_by_end(usage_events(spark, d))
    return out.select("id", "circuit", F.round("seconds_since_prev_event", 6).alias("gap"), "prev_cluster_id")


@query(""", c AS (SELECT label AS center_id, list(embedding ORDER BY vec_id)[1] AS c FROM embeddings GROUP BY label)
SELECT vec_id, arg_min(center_id, (d, center_id)) AS center_id, round(min(d), 4) AS distance FROM (SELECT e.vec_id, c.center_id, sqrt(list_sum(list_transform(range(1, len(c.c) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(c.c[i] AS DOUBLE)) ^ 2))) AS d FROM embeddings e CROSS JOIN c) GROUP BY vec_id""")
def jn11(spark, d):
    vectors = table(spark, d, "embeddings")
    centers = vectors.groupBy(F.col("label").alias("center_id")).agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("c"))
    return rel.nearest_center(vectors, centers, "embedding", "c").select("vec_id", "center_id", F.round("distance", 4).alias("distance"))


@query("""SELECT vec_id, arg_min(center_id, (d, center_id)) AS center_id, round(min(d), 4) AS distance FROM (SELECT e.vec_id, c.vec_id AS center_id, array_distance(CAST(e.embedding AS DOUBLE[64]), CAST(c.embedding AS DOUBLE[64])) AS d
FROM embeddings e JOIN embeddings c ON c.label = 0) GROUP BY vec_id""")
def jn11_pivots(spark, d):
    """Every vector against all those of the first label as centers, by pivots."""
    vectors = table(spark, d, "embeddings")
    centers = vectors.where("label = 0").select(F.col("vec_id").alias("center_id"), F.col("embedding").cast("array<double>").alias("c"))
    return rel.nearest_by_pivots(vectors, centers, "embedding", "c", pivots=16, block=32).select("vec_id", "center_id", F.round("distance", 4).alias("distance"))


@query("SELECT circuit, " + ", ".join(f"arg_max(value, (ts, id)) FILTER (sensor = {i}) AS s{i}" for i in range(8)) + " FROM r GROUP BY circuit")
def jn12(spark, d):
    """Each circuit's live state: the last value of each of its eight sensors."""
    own = readings(spark, d).withColumn("role", F.concat(F.lit("s"), F.col("sensor").cast("string")))
    return rel.pivot_latest(own, "circuit", "role", [f"s{i}" for i in range(8)], "ts", "value")


@query(f", {DAYS} SELECT a.circuit, a.day, round(a.total_volume, 4) AS total_volume, round(b.v, 4) AS prior_volume FROM days a LEFT JOIN (SELECT circuit, CAST(day + INTERVAL 1 MONTH AS DATE) AS day, sum(total_volume) AS v FROM (SELECT circuit, CAST(day - INTERVAL 15 DAY AS DATE) AS day, total_volume FROM days) GROUP BY ALL) b USING (circuit, day)")
def jn13(spark, d):
    daily = days(usage_events(spark, d))
    shifted = daily.withColumn("day", F.date_sub("day", 15))
    prior = rollups.year_over_year(shifted.unionByName(daily.withColumn("day", F.add_months(F.date_sub("day", 15), 1)).withColumn("total_volume", F.lit(None).cast("double"))), 1)
    own = prior.where("total_volume is null").select("circuit", "day", "prior_volume").distinct()
    return daily.join(own, ["circuit", "day"], "left").select("circuit", "day", F.round("total_volume", 4).alias("total_volume"), F.round("prior_volume", 4).alias("prior_volume"))


ROLES = {"valve": ("red", "^(?!.*ring).*(widget|bolt)"), "meter": ("blue", "widget|gear"), "gauge": ("small", "ring|anvil")}


@query("""SELECT device_id, role, min(entity_id) AS entity_id FROM (SELECT p_brand AS device_id, p_name || ' ' || p_partkey AS entity_id, p_name AS name, split_part(p_name, ' ', 1) AS domain FROM part) p
JOIN (VALUES ('valve', 'red', '^[^g]*(widget|bolt)'), ('meter', 'blue', 'widget|gear'), ('gauge', 'small', 'ring|anvil')) v(role, dom, pattern) ON p.domain = v.dom AND regexp_matches(p.name, v.pattern, 'i') GROUP BY ALL""")
def jn14(spark, d):
    parts = table(spark, d, "part")
    own = parts.select(F.col("p_brand").alias("device_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("domain"))
    return rel.match_roles(own, ROLES)


@query("SELECT c.circuit, c.n, l.last_value, t.any_alert FROM (SELECT circuit, count(*) AS n FROM u GROUP BY 1) c LEFT JOIN (SELECT circuit, arg_max(value, (ts, id)) AS last_value FROM r GROUP BY 1) l USING (circuit) LEFT JOIN (SELECT circuit, bool_or(triggered_alert) AS any_alert FROM u GROUP BY 1) t USING (circuit)")
def jn15(spark, d):
    u = usage_events(spark, d)
    live = rel.latest_states(readings(spark, d), ["circuit"], value="value").select("circuit", F.col("value").alias("last_value"))
    return u.groupBy("circuit").agg(F.count("*").alias("n")).join(live, "circuit", "left").join(u.groupBy("circuit").agg(F.bool_or("triggered_alert").alias("any_alert")), "circuit", "left")


@query("SELECT id, circuit, start_ts FROM u ORDER BY start_ts DESC, id LIMIT 100")
def srt01(spark, d):
    return rel.recent(usage_events(spark, d)).select("id", "circuit", "start_ts")


@query("SELECT id, circuit, start_ts FROM u WHERE CAST(start_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def flt01(spark, d):
    day = lambda s: F.lit(s).cast("date")
    return rel.recent(usage_events(spark, d), 100, day("2024-01-05"), day("2024-01-07")).select("id", "circuit", "start_ts")


@query("SELECT circuit, id, start_ts FROM (SELECT *, row_number() OVER (PARTITION BY circuit ORDER BY start_ts DESC, id) AS p FROM u WHERE triggered_alert) WHERE p <= 20")
def srt02(spark, d):
    return rel.quiet_rank(usage_events(spark, d).where("triggered_alert"), ["circuit"], [F.desc("start_ts"), F.col("id")], 20).select("circuit", "id", "start_ts")


@query("SELECT circuit, arg_max(state, (ts, id)) AS state, max(ts) AS ts FROM r GROUP BY circuit")
def src04(spark, d):
    return rel.latest_states(readings(spark, d), ["circuit"])


@query("SELECT p_partkey, CAST(1 AS INTEGER) AS tier FROM part WHERE lower(p_name) = 'red widget'")
def flt15(spark, d):
    return rel.tiered_search(table(spark, d, "part"), "Red Widget", ["p_name", "p_type"], F.col("p_brand") == "Brand#1").select("p_partkey", "tier")


@query("SELECT circuit, cluster_id, member_count, CASE WHEN member_count < 50 THEN 'low' WHEN member_count < 200 THEN 'medium' ELSE 'high' END AS level FROM clusters")
def flt09(spark, d):
    from tidewatch.functions.scalars import confidence_level

    return clusters(usage_events(spark, d)).select("circuit", "cluster_id", "member_count", confidence_level(F.col("member_count")).alias("level"))


@query(f", {HOURS}, slots AS (SELECT circuit, unnest(generate_series(date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 23 HOUR, date_trunc('hour', TIMESTAMP '{AS_OF}'), INTERVAL 1 HOUR)) AS hour_ts FROM (SELECT DISTINCT circuit FROM u)) SELECT circuit, hour_ts, round(coalesce(volume, 0e0), 2) AS volume FROM slots LEFT JOIN hours USING (circuit, hour_ts)")
def win14(spark, d):
    u = usage_events(spark, d)
    return rollups.day_series(rollups.hourly_volume(u), circuits(u), now())


@query(f""", {PROFILE}, o AS (SELECT circuit, list({{'a': avg_volume, 'h': hr}} ORDER BY avg_volume, hr) AS l FROM profile GROUP BY circuit)
SELECT circuit, list_reduce(l, lambda b, x: CASE WHEN x.a < 0.95e0 * b.a OR x.a < 1.05e0 * b.a AND x.h BETWEEN 0 AND 5 THEN x ELSE b END).h AS hr FROM o""")
def win19(spark, d):
    return rollups.quiet_hour(rollups.hour_profile(rollups.hourly_volume(usage_events(spark, d))))


@query("SELECT 'events' AS name, count(*) AS rows, count(*) * 200 AS bytes FROM u UNION ALL SELECT 'clusters', count(*), count(*) * 350 FROM clusters")
def snk16(spark, d):
    u = usage_events(spark, d)
    return rollups.table_sizes({"events": (u, 200), "clusters": (clusters(u), 350)})
