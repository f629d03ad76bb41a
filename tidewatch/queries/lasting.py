"""Live subscriptions, tables changed in place, meters and the training life cycle."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewatch.operators import leaktests, lifecycle, meters, migrations, rollups, rules, storage, tableset
from tidewatch.operators import relational as rel
from tidewatch.queries import AS_OF, query, settled
from tidewatch.sources import live
from tidewatch.sources.history import clusters, readings, shared_folder, table, usage_events, write_backup
from tidewatch.streaming import live_state

NOON = "2024-01-12 12:00:00"


def new_folder(spark, tag):
    return f"{shared_folder(spark)}/tidewatch/{tag}-{uuid.uuid4().hex}"


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def diffs(spark, d):
    """Each event as one diff of its sensor: views and clicks name the state only, signups the attribute ``k`` only, the others both; eight folders by day."""
    e = table(spark, d, "events")
    named = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    return e.select(
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) % 8).cast("long").alias("seq"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit("."), (F.col("user_id") % 8).cast("string")).alias("entity_id"),
        F.when(F.col("event_type") != "signup", F.col("value").cast("string")).alias("state"), F.when(~F.col("event_type").isin("view", "click"), named).alias("attributes"),
    )


DIFFS = """SELECT event_id AS n, ts, event_type || '.' || (user_id % 8) AS entity_id, CASE WHEN event_type <> 'signup' THEN value END AS s, CASE WHEN event_type NOT IN ('view', 'click') THEN json_extract_string(props, '$.k') END AS k FROM events"""


@query(f"SELECT entity_id, n, last_value(s IGNORE NULLS) OVER w AS state, last_value(k IGNORE NULLS) OVER w AS k FROM ({DIFFS}) WINDOW w AS (PARTITION BY entity_id ORDER BY ts, n ROWS UNBOUNDED PRECEDING)")
def src01(spark, d):
    """Partial diffs of a subscription, read back and merged: the full state of a sensor after each."""
    path = new_folder(spark, "diffs")
    live.write_diffs(diffs(spark, d), path)
    return live.full_states(live.subscribed(spark, path), ["k"]).select("entity_id", "n", F.col("state").cast("double").alias("state"), "k")


@query(f"SELECT entity_id, count(*) AS changes, count(DISTINCT n) AS messages, min(n) AS first_n, max(n) AS last_n FROM ({DIFFS}) GROUP BY entity_id")
def str03_live(spark, d):
    """A stream that loses what comes with a value over 90 in its first run, is rewound to the earliest such time, and stores nothing twice."""
    path, target, checkpoint = (new_folder(spark, t) for t in ("diffs", "changes", "checkpoint"))
    live.write_diffs(diffs(spark, d), path)
    full = lambda batch, number: batch.where("try_cast(state as double) <= 90 or state is null")
    live.store_changes(live.subscribed(spark, path, stream=True), target, checkpoint, full).awaitTermination()
    dropped = live.subscribed(spark, path).where("try_cast(state as double) > 90").agg(F.min("ts").alias("t")).first()["t"]
    if dropped is not None:
        live.rewind(spark, path, dropped)
    live.store_changes(live.subscribed(spark, path, stream=True), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).groupBy("entity_id").agg(F.count("*").alias("changes"), F.count_distinct("n").alias("messages"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


SUMMARY_ROW = "circuit string, event_count long, total_volume double, peak_flow double, computed_at timestamp_ntz, day date"


@query("SELECT circuit, CAST(start_ts AS DATE) AS day, count(*) AS event_count, round(sum(volume_litres) + 1e-9, 4) AS total_volume, max(peak_flow_lpm) AS peak_flow FROM u GROUP BY ALL")
def snk04_days(spark, d):
    """Summaries made at noon of a day, then those of the days that are missing or were not over made again: only these days are written."""
    u, path = usage_events(spark, d), new_folder(spark, "daily")
    columns = [c.split()[0] for c in SUMMARY_ROW.split(", ")]
    early = rollups.daily_summary(u.where(F.col("start_ts") < stamp(NOON))).withColumn("computed_at", stamp(NOON)).select(*columns)
    storage.upsert_days(path, early, ["circuit", "day"], SUMMARY_ROW, "computed_at")
    stored = storage.read_days(spark, path, SUMMARY_ROW)
    late = u.withColumn("day", F.to_date("start_ts")).join(rel.days_to_summarise(u, stored), ["circuit", "day"], "left_semi")
    again = rollups.daily_summary(late).withColumn("computed_at", stamp("2024-03-01 00:00:00")).select(*columns)
    storage.upsert_days(path, again, ["circuit", "day"], SUMMARY_ROW, "computed_at")
    return storage.read_days(spark, path, SUMMARY_ROW).select("circuit", "day", "event_count", settled("total_volume", 4).alias("total_volume"), "peak_flow")


FIXTURE_ROW = "circuit string, fixture_id string, event_count long, avg_flow double, run long, day date"


@query("SELECT circuit, fixture_id, CAST(start_ts AS DATE) AS day, count(*) AS event_count, round(avg(avg_flow_lpm) + 1e-9, 4) AS avg_flow FROM u WHERE fixture_id IS NOT NULL GROUP BY ALL")
def snk05_days(spark, d):
    """Fixture days of the events known without their alerts, replaced by those of all events where an alert changes them."""
    u, path = usage_events(spark, d), new_folder(spark, "fixture-days")
    columns = [c.split()[0] for c in FIXTURE_ROW.split(", ")]
    for run, own in enumerate((u.where("not triggered_alert"), u.withColumn("day", F.to_date("start_ts")).join(u.where("triggered_alert and fixture_id is not null").select("circuit", "fixture_id", F.to_date("start_ts").alias("day")).distinct(), ["circuit", "fixture_id", "day"], "left_semi"))):
        rows = rollups.fixture_days(own).withColumn("run", F.lit(run).cast("long")).select(*columns)
        storage.upsert_days(path, rows, ["circuit", "fixture_id", "day"], FIXTURE_ROW, "run")
    return storage.read_days(spark, path, FIXTURE_ROW).select("circuit", "fixture_id", "day", "event_count", settled("avg_flow", 4).alias("avg_flow"))


HOUR_ROW = "circuit string, hour_ts timestamp_ntz, volume double, day date"


@query("SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, round(sum(volume_litres) + 1e-9, 4) AS volume FROM u GROUP BY ALL")
def snk02_days(spark, d):
    """Hourly volumes of the events without an alert, then those of the others added."""
    u, path = usage_events(spark, d), new_folder(spark, "hours")
    for own in (u.where("not triggered_alert"), u.where("triggered_alert")):
        storage.add_days(path, rollups.hourly_volume(own).withColumn("day", F.to_date("hour_ts")), ["circuit", "hour_ts", "day"], "volume", HOUR_ROW)
    return storage.read_days(spark, path, HOUR_ROW).select("circuit", "hour_ts", settled("volume", 4).alias("volume"))


CUT = "2024-01-20 00:00:00"
WINDOWS = "w AS (SELECT circuit, min(start_ts) + INTERVAL 2 DAY AS a, min(start_ts) + INTERVAL 100 HOUR AS b FROM u GROUP BY circuit)"


def training_windows(u):
    """Each circuit's window: from two days after its first event, for a little over two days."""
    first = u.groupBy("circuit").agg(F.min("start_ts").alias("s"))
    return first.select("circuit", F.expr("s + interval 2 days").alias("started_at"), F.expr("s + interval 100 hours").alias("ends_at"))


@query(f", {WINDOWS} SELECT id, circuit, start_ts FROM u WHERE start_ts >= TIMESTAMP '{CUT}' OR EXISTS (SELECT 1 FROM w WHERE w.circuit = u.circuit AND u.start_ts BETWEEN a AND b)")
def dml01_days(spark, d):
    """Events kept by day; retention rewrites the days that lose rows and drops those that keep none."""
    u, path = usage_events(spark, d), new_folder(spark, "events")
    kind = "id long, circuit string, start_ts timestamp_ntz, day date"
    storage.write_days(u.select("id", "circuit", "start_ts", F.to_date("start_ts").alias("day")), path)
    storage.delete_days(spark, path, kind, storage.outside_windows("start_ts", stamp(CUT), training_windows(u)), date(2024, 1, 20))
    return storage.read_days(spark, path, kind).drop("day")


@query(f", {WINDOWS} SELECT circuit, hour_ts, n FROM (SELECT circuit, date_trunc('hour', start_ts) AS hour_ts, count(*) AS n FROM u GROUP BY ALL) h WHERE hour_ts >= TIMESTAMP '{CUT}' OR EXISTS (SELECT 1 FROM w WHERE w.circuit = h.circuit AND hour_ts BETWEEN a AND b)")
def dml02_days(spark, d):
    u, path = usage_events(spark, d), new_folder(spark, "hours")
    kind = "circuit string, hour_ts timestamp_ntz, n long, day date"
    hours = u.groupBy("circuit", F.date_trunc("hour", "start_ts").cast("timestamp_ntz").alias("hour_ts")).agg(F.count("*").alias("n"))
    storage.write_days(hours.withColumn("day", F.to_date("hour_ts")), path)
    storage.delete_days(spark, path, kind, storage.outside_windows("hour_ts", stamp(CUT), training_windows(u)), date(2024, 1, 20))
    return storage.read_days(spark, path, kind).drop("day")


@query(f"""SELECT 'fixture_days' AS name, count(*) AS n FROM (SELECT DISTINCT circuit, fixture_id, CAST(start_ts AS DATE) AS day FROM u WHERE fixture_id IS NOT NULL) WHERE day >= DATE '2024-01-20'
UNION ALL SELECT 'flow_history', count(*) FROM r WHERE ts >= TIMESTAMP '{CUT}' UNION ALL SELECT 'windows', count(*) FROM u WHERE triggered_alert AND end_ts >= TIMESTAMP '2024-01-18 06:30:00'""")
def dml03_days(spark, d):
    """Plain cutoffs of three tables: by the day itself, by time, and a shorter one for windows by their end."""
    u = usage_events(spark, d)
    tables = {
        "fixture_days": (rollups.fixture_days(u).select("circuit", "fixture_id", F.col("day").cast("timestamp_ntz").alias("at"), "day"), "circuit string, fixture_id string, at timestamp_ntz, day date", CUT),
        "flow_history": (readings(spark, d).select("id", F.col("ts").alias("at"), F.to_date("ts").alias("day")), "id long, at timestamp_ntz, day date", CUT),
        "windows": (u.where("triggered_alert").select("id", F.col("end_ts").alias("at"), F.to_date("end_ts").alias("day")), "id long, at timestamp_ntz, day date", "2024-01-18 06:30:00"),
    }
    out = None
    for name, (rows, kind, cut) in tables.items():
        path = new_folder(spark, name)
        storage.write_days(rows, path)
        storage.delete_days(spark, path, kind, storage.from_cutoff("at", stamp(cut)), datetime.fromisoformat(cut).date())
        part = storage.read_days(spark, path, kind).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


METERS = """, f AS (SELECT circuit, CAST(ts AS DATE) AS day, list(value ORDER BY ts, id) AS v, min(ts) AS t0 FROM r GROUP BY ALL),
b AS (SELECT circuit, day, v, list_reduce(list_prepend(CASE WHEN t0 <= day + INTERVAL 2 HOUR THEN v[1] ELSE 0e0 END, v), lambda base, x: CASE WHEN x < base THEN x ELSE base END) AS base FROM f),
w AS (SELECT b.circuit, b.day, b.v, b.base, list_reduce(list_prepend(coalesce(p.base, 0e0), b.v), lambda base, x: CASE WHEN x < base THEN x ELSE base END) AS week_base FROM b LEFT JOIN b p ON p.circuit = b.circuit AND p.day + 7 = b.day)"""


@query(f"{METERS} SELECT circuit, day, round(greatest(0e0, v[-1] - base) + 1e-9, 1) AS used, round(greatest(0e0, v[-1] - week_base) + 1e-9, 1) AS used_week FROM w")
def agg14(spark, d):
    """A meter that may start again from zero: volume of the day, and since midnight seven days before."""
    out = meters.day_usage(readings(spark, d))
    return out.select("circuit", "day", settled("used_day", 1).alias("used"), settled("used_week", 1).alias("used_week"))


@query(f"""{METERS} SELECT id, r.circuit, round(greatest(0e0, value - least(min(value) OVER d, CASE WHEN min(ts) OVER d <= CAST(ts AS DATE) + INTERVAL 2 HOUR THEN value ELSE 0e0 END)) + 1e-9, 1) AS used,
round(greatest(0e0, value - least(min(value) OVER d, coalesce(p.base, 0e0))) + 1e-9, 1) AS used_week FROM r LEFT JOIN b p ON p.circuit = r.circuit AND p.day + 7 = CAST(r.ts AS DATE) WINDOW d AS (PARTITION BY r.circuit, CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""")
def agg14_running(spark, d):
    out = meters.running_usage(readings(spark, d))
    return out.select("id", "circuit", settled("used_day", 1).alias("used"), settled("used_week", 1).alias("used_week"))


def training(spark, d):
    """Commands dealt from the durations of events, and the events that count."""
    u = usage_events(spark, d)
    k = F.col("duration_seconds")
    kind = F.when(k == 96, "recalibrate").when(k == 97, "stop").when(k == 98, "activate").when((k >= 92) & (k < 96), "start")
    commands = u.withColumn("kind", kind).where("kind is not null").select("circuit", "id", F.col("start_ts").alias("ts"), "kind", (F.col("user_id") % 3).cast("int").alias("days"), (F.col("user_id") % 40).cast("long").alias("minimum"))
    return commands, u.where("not excluded").select("circuit", "id", F.col("start_ts").alias("ts"))


HISTORY = """,
ev AS (SELECT circuit, id, start_ts, row_number() OVER (PARTITION BY circuit ORDER BY start_ts, id) AS n FROM u WHERE NOT excluded),
c0 AS (SELECT circuit, id, start_ts, epoch_us(start_ts) / 1e6 AS t, CASE WHEN k = 96 THEN 'recalibrate' WHEN k = 97 THEN 'stop' WHEN k = 98 THEN 'activate' ELSE 'start' END AS kind, user_id % 3 AS days, user_id % 40 AS minimum FROM (SELECT *, duration_seconds AS k FROM u) WHERE k >= 92 AND k < 99),
c1 AS (SELECT c0.*, (SELECT count(*) FROM ev WHERE ev.circuit = c0.circuit AND ev.start_ts <= c0.start_ts) AS seen FROM c0),
c2 AS (SELECT c1.*, CASE WHEN kind IN ('start', 'recalibrate') AND (minimum = 0 OR ev.id IS NOT NULL) THEN greatest(ceil(greatest(t + days * 86400, coalesce(epoch_us(ev.start_ts) / 1e6, 0)) / 60) * 60, (floor(t / 60) + 1) * 60) END AS done FROM c1 LEFT JOIN ev ON minimum > 0 AND ev.circuit = c1.circuit AND ev.n = seen + minimum),
c AS (SELECT circuit, id, t, kind, done, done + 604800 AS live FROM c2),
first AS (SELECT circuit, arg_min(id, (t, id)) AS id FROM c WHERE kind IN ('start', 'recalibrate') GROUP BY circuit),
p AS (SELECT c.*, (SELECT arg_min(x.id, (x.t, x.id)) FROM c x WHERE x.circuit = c.circuit AND (x.t, x.id) > (c.t, c.id) AND x.kind IN ('start', 'recalibrate')) AS n_idle,
 (SELECT arg_min(x.id, (x.t, x.id)) FROM c x WHERE x.circuit = c.circuit AND (x.t, x.id) > (c.t, c.id) AND x.kind IN ('stop', 'recalibrate')) AS n_on,
 (SELECT arg_min(x.id, (x.t, x.id)) FROM c x WHERE x.circuit = c.circuit AND x.t >= c.done) AS n_label,
 (SELECT arg_min(x.id, (x.t, x.id)) FROM c x WHERE x.circuit = c.circuit AND x.t >= c.live AND x.kind IN ('stop', 'recalibrate')) AS n_live FROM c),
q AS (SELECT p.*, CASE WHEN p.kind IN ('stop', 'activate') THEN 'plain' WHEN p.done IS NULL OR o.t < p.done THEN 'calibrating' WHEN l.t < p.live THEN 'labelling' ELSE 'live' END AS ends FROM p LEFT JOIN c o ON o.id = p.n_on LEFT JOIN c l ON l.id = p.n_label),
s AS (SELECT q.*, CASE WHEN kind = 'stop' THEN n_idle WHEN ends = 'labelling' THEN n_label WHEN ends = 'live' THEN n_live ELSE n_on END AS nxt FROM q),
walk AS (SELECT s.* FROM s JOIN first USING (id) UNION ALL SELECT s.* FROM walk JOIN s ON s.id = walk.nxt),
y AS (SELECT w.*, n.t AS tn FROM walk w LEFT JOIN c n ON n.id = w.nxt),
z AS (SELECT circuit, 'idle' AS state, t AS a, tn AS b FROM y WHERE kind = 'stop' UNION ALL SELECT circuit, 'live', t, tn FROM y WHERE kind = 'activate'
 UNION ALL SELECT circuit, 'calibrating', t, CASE WHEN ends = 'calibrating' THEN tn ELSE done END FROM y WHERE ends <> 'plain'
 UNION ALL SELECT circuit, 'labelling', done, CASE WHEN ends = 'labelling' THEN tn ELSE live END FROM y WHERE ends IN ('labelling', 'live') UNION ALL SELECT circuit, 'live', live, tn FROM y WHERE ends = 'live'),
h AS (SELECT circuit, state, make_timestamp(CAST(round(a * 1e6) AS BIGINT)) AS from_ts, make_timestamp(CAST(round(b * 1e6) AS BIGINT)) AS to_ts FROM z WHERE b IS NULL OR b > a)"""



@query(f"{HISTORY} SELECT circuit, state, from_ts, to_ts, CASE WHEN state = 'calibrating' THEN (SELECT count(*) FROM ev WHERE ev.circuit = h.circuit AND ev.start_ts > h.from_ts AND (h.to_ts IS NULL OR ev.start_ts <= h.to_ts)) END AS events_collected FROM h", recursive=True)
def st02(spark, d):
    """The life cycle of each circuit's training, with the events that each calibration collected."""
    return lifecycle.state_history(*training(spark, d)).drop("command_id")


@query(f"{HISTORY} SELECT u.id, u.circuit, coalesce(h.state, 'idle') AS state FROM u LEFT JOIN h ON h.circuit = u.circuit AND u.start_ts >= h.from_ts AND (h.to_ts IS NULL OR u.start_ts < h.to_ts)", recursive=True)
def st02_states(spark, d):
    history = lifecycle.state_history(*training(spark, d))
    return lifecycle.state_at(usage_events(spark, d).select("id", "circuit", F.col("start_ts").alias("ts")), history).select("id", "circuit", "state")


def line(spark, d):
    """The events as what a valve's board says: commands, end stops, faults and pressures by sensor."""
    return readings(spark, d).join(usage_events(spark, d).select("id", "duration_seconds"), "id")


def leak_tests(spark, d):
    own = line(spark, d)
    value = F.col("value")
    commands = own.where("sensor = 0").select("circuit", "id", "ts", F.when(value >= 10, "run").otherwise("stop").alias("kind"), (60 + 10 * F.col("duration_seconds")).alias("minutes"))
    role = F.when(F.col("sensor") == 1, "open_stop").when(F.col("sensor") == 2, "closed_stop").otherwise("fault")
    is_on = F.when(F.col("sensor") == 1, value >= 2).when(F.col("sensor") == 2, value < 1).otherwise(value > 60)
    states = own.where("sensor in (1, 2, 3)").select("circuit", "id", "ts", role.alias("role"), is_on.alias("is_on"))
    pressures = own.where("sensor >= 4").select("circuit", "id", "ts", (40 + value % 7).alias("pressure"), (value / 8).alias("drop_5s"))
    return leaktests.leak_test_history(commands, states, pressures)


_STATE = "(SELECT arg_max({what}, (x.ts, x.id)) FROM l x WHERE x.circuit = c.circuit AND x.sensor {sensor} AND x.ts <= c.ts{later})"
LEAKS = f""",
l AS (SELECT r.*, epoch_us(ts) / 1e6 AS t, duration_seconds AS k FROM r JOIN (SELECT id, duration_seconds FROM u) USING (id)),
c AS (SELECT circuit, id, ts, t, CASE WHEN value >= 10 THEN 'run' ELSE 'stop' END AS kind, 60 + 10 * k AS minutes FROM l WHERE sensor = 0),
a AS (SELECT c.*, t + 60 + minutes * 60 AS over, {_STATE.format(what="x.value >= 2", sensor="= 1", later="")} AS opened, {_STATE.format(what="x.value < 1", sensor="= 2", later="")} AS closed, {_STATE.format(what="x.value > 60", sensor="= 3", later="")} AS broken,
 {_STATE.format(what="40 + x.value % 7", sensor=">= 4", later=" + INTERVAL 60 SECOND")} AS baseline FROM c WHERE kind = 'run'),
b AS (SELECT a.*, CASE WHEN coalesce(closed, false) OR NOT coalesce(opened, false) THEN 6 WHEN coalesce(broken, false) THEN 7 END AS refused, (SELECT min(x.t) FROM c x WHERE x.kind = 'stop' AND x.circuit = a.circuit AND x.t >= a.t) AS stopped,
 coalesce((SELECT min(x.t) FROM l x WHERE x.circuit = a.circuit AND x.sensor >= 4 AND x.t >= a.over), 1e18) AS until FROM a),
s AS (SELECT b.id, l.t, l.id AS pid, CASE WHEN 40 + value % 7 - baseline > 3 THEN 4 WHEN value / 8 > 10 THEN 9 WHEN baseline - (40 + value % 7) > 3 THEN 3 WHEN l.t >= b.over THEN 2 END AS r FROM b JOIN l ON l.circuit = b.circuit AND l.sensor >= 4 AND l.t >= b.t + 60 AND l.t <= b.until WHERE refused IS NULL),
f AS (SELECT id, min(t) AS ft, arg_min(r, (t, pid)) AS fr FROM s WHERE r IS NOT NULL GROUP BY id),
e AS (SELECT b.circuit, b.id, b.ts, b.t, CASE WHEN refused IS NULL THEN baseline END AS baseline, CASE WHEN refused IS NOT NULL THEN refused WHEN stopped IS NOT NULL AND (ft IS NULL OR stopped <= ft) THEN 5 ELSE fr END AS result,
 CASE WHEN refused IS NOT NULL THEN b.t WHEN stopped IS NOT NULL AND (ft IS NULL OR stopped <= ft) THEN stopped ELSE ft END AS ended FROM b LEFT JOIN f USING (id)),
n AS (SELECT e.*, (SELECT arg_min(x.id, (x.t, x.id)) FROM e x WHERE x.circuit = e.circuit AND x.t >= e.ended + 1e-6) AS nxt FROM e),
walk AS (SELECT n.* FROM n JOIN (SELECT arg_min(id, (t, id)) AS id FROM n GROUP BY circuit) USING (id) UNION ALL SELECT n.* FROM walk JOIN n ON n.id = walk.nxt),
tests AS (SELECT circuit, id, ts AS started_at, CAST(result AS INTEGER) AS result, make_timestamp(CAST(round(ended * 1e6) AS BIGINT)) AS ended_at, round(baseline + 1e-9, 3) AS baseline FROM walk)"""


@query(f"{LEAKS} SELECT * FROM tests", recursive=True)
def st04_history(spark, d):
    """Leak tests from the command to the result, with what refuses one, a minute of settling and a measured baseline."""
    return leak_tests(spark, d).withColumn("baseline", settled("baseline", 3))


def fault_changes(spark, d):
    own, value = line(spark, d), F.col("value")
    bursts = rules.faults(own.select("circuit", "id", "ts", value.alias("raw_flow"), (value / 2).alias("flow"), (F.col("sensor") * 2).alias("drop_5s"))).where("fault_kind is not null").select("circuit", "id", "ts", F.col("fault_kind").alias("reason"))
    failed = leak_tests(spark, d).where(F.col("result") == rules.LEAK_RESULTS["failed"]).select("circuit", "id", F.col("ended_at").alias("ts"), F.lit("leak_test").alias("reason"))
    valve = own.where("sensor = 1").select("circuit", "id", "ts", F.when(value >= 20, "open").otherwise("close").alias("kind"))
    stops = own.where("sensor = 2").select("circuit", "id", "ts", F.when(value >= 20, "open_stop").otherwise("closed_stop").alias("role"), (value < 60).alias("is_on"))
    stuck = leaktests.travel_faults(valve, stops, 14400).select("circuit", "id", "ts", F.lit("motor_timeout").alias("reason"))
    resets = own.where("sensor = 5 and value < 20").select("circuit", "id", "ts")
    return leaktests.fault_history(bursts.unionByName(failed).unionByName(stuck), resets)


_STOP = "x.circuit = v.circuit AND x.sensor = 2 AND (x.value >= 20) = (v.value >= 20)"


@query(f"""{LEAKS},
v AS (SELECT * FROM l WHERE sensor = 1),
late AS (SELECT circuit, id, ts + INTERVAL 4 HOUR AS ts FROM v WHERE NOT coalesce((SELECT arg_max(x.value < 60, (x.ts, x.id)) FROM l x WHERE {_STOP} AND x.ts <= v.ts), false) AND NOT EXISTS (SELECT 1 FROM l x WHERE {_STOP} AND x.value < 60 AND x.t BETWEEN v.t AND v.t + 14400)
 AND NOT EXISTS (SELECT 1 FROM v o WHERE o.circuit = v.circuit AND o.t > v.t AND o.t < v.t + 14400)),
g AS (SELECT circuit, id, ts, CASE WHEN value > 37.5 THEN 'instant_burst' WHEN value / 2 > 25 THEN 'burst' WHEN sensor * 2 > 10 AND value > 0 THEN 'rapid_drop' END AS reason, 0 AS reset FROM l
 UNION ALL SELECT circuit, id, ended_at, 'leak_test', 0 FROM tests WHERE result = 3 UNION ALL SELECT circuit, id, ts, 'motor_timeout', 0 FROM late UNION ALL SELECT circuit, id, ts, NULL, 1 FROM l WHERE sensor = 5 AND value < 20),
h AS (SELECT *, sum(reset) OVER (PARTITION BY circuit ORDER BY ts, reset, id ROWS UNBOUNDED PRECEDING) AS run FROM g WHERE reason IS NOT NULL OR reset = 1)
SELECT circuit, id, ts, reset = 0 AS is_on, CASE WHEN reset = 0 THEN first_value(reason) OVER (PARTITION BY circuit, run, reset ORDER BY ts, id) END AS reason FROM h""", recursive=True)
def st07_faults(spark, d):
    """Faults of bursts, rapid drops, failed leak tests and valves that travel too long, on until a reset, with the first reason."""
    return fault_changes(spark, d)


def roles(spark, d):
    """Readings of ten roles, dealt from the users of the events; alarms are on from a value of 30, some say nothing."""
    value, kind = F.col("value"), F.element_at(F.array(*[F.lit(r) for r in live_state.ROLES]), (F.col("user_id") % 10 + 1).cast("int"))
    own = table(spark, d, "events").select("event_type", "event_id", "ts", "value", "user_id", kind.alias("role"))
    on = F.when(value >= 30, "on").otherwise("off")
    state = F.when(F.col("role") == "valve", F.when(value >= 30, "open").otherwise("closed")).when(F.col("role").isin("fault", "trickle", "leak_test"), on)
    state = state.when(F.col("role").isin("fault_reason", "leak_test_result"), F.when(value >= 5, F.concat(F.lit("reason "), F.floor(value).cast("string"))).otherwise("unknown")).when(value < 1, "unavailable").otherwise(value.cast("string"))
    return own.select(F.concat_ws("/", F.col("event_type"), F.to_date("ts").cast("string")).alias("circuit"), F.col("event_id").alias("id"), "ts", "role", state.alias("state"))


_TTL = "CASE WHEN newest - INTERVAL {n} SECOND <= max(ts) FILTER (role = '{r}') THEN arg_max(state, (ts, id)) FILTER (role = '{r}') END AS {r}"
_ROLE_COLUMNS = ", ".join(_TTL.format(r=r, n=live_state.TTL.get(r, 10**9)) for r in live_state.ROLES)


@query(f""", q AS (SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS circuit, event_id AS id, ts, value, {live_state.ROLES}[CAST(user_id % 10 + 1 AS INTEGER)] AS role FROM events),
p AS (SELECT *, CASE WHEN role = 'valve' THEN CASE WHEN value >= 30 THEN 'open' ELSE 'closed' END WHEN role IN ('fault', 'trickle', 'leak_test') THEN CASE WHEN value >= 30 THEN 'on' ELSE 'off' END
 WHEN role IN ('fault_reason', 'leak_test_result') THEN CASE WHEN value >= 5 THEN 'reason ' || CAST(floor(value) AS BIGINT) ELSE 'unknown' END WHEN value < 1 THEN 'unavailable' ELSE CAST(value AS VARCHAR) END AS state FROM q),
n AS (SELECT *, max(ts) OVER (PARTITION BY circuit) AS newest FROM p), l AS (SELECT circuit, {_ROLE_COLUMNS} FROM n GROUP BY circuit, newest)
SELECT circuit, coalesce(valve, 'unknown') AS valve_state, TRY_CAST(coalesce(CASE WHEN pressure_history NOT IN ('unknown', 'unavailable', '') THEN pressure_history END, pressure_avg) AS DOUBLE) AS pressure, coalesce(TRY_CAST(flow AS DOUBLE), 0e0) AS flow_rate,
 coalesce(fault = 'on', false) AS fault_active, CASE WHEN fault = 'on' THEN coalesce(CASE WHEN fault_reason NOT IN ('unknown', 'unavailable', '') THEN fault_reason END, '') ELSE '' END AS fault_reason, coalesce(trickle = 'on', false) AS trickle_active,
 coalesce(leak_test = 'on', false) AS leak_test_active, coalesce(leak_test_result, 'No test run') AS leak_test_result, TRY_CAST(volume AS DOUBLE) AS volume_total FROM l""")
def jn12_live(spark, d):
    """What a panel shows of each circuit (here one a day) from the last values of ten roles, three of which go stale after ten minutes."""
    return live_state.shown(live_state.latest_roles(roles(spark, d)))


@query(f"""SELECT 'events' AS name, circuit, count(*) AS n FROM u WHERE start_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 12 DAY GROUP BY circuit
UNION ALL SELECT 'clusters', circuit, count(*) FROM clusters GROUP BY circuit UNION ALL SELECT 'other', 'kept', count(DISTINCT circuit) FROM u""")
def src08_tables(spark, d):
    """All tables of a backup restored at once over a stale state: what the backup lacks is emptied, what is not restored stays."""
    u, base = usage_events(spark, d), new_folder(spark, "set")
    target, backup = tableset.TableSet(spark, base), new_folder(spark, "backup")
    events = u.select("id", "circuit", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_ts"), "cluster_id")
    stale = {"events": events.where("cluster_id is null"), "clusters": clusters(u).select("circuit", "cluster_id"), "hours": events.select("circuit").distinct(), "other": u.select("circuit").distinct()}
    target.commit(stale, migrations.LATEST)
    write_backup({"events": events.where(F.col("start_ts") >= F.date_format(stamp(AS_OF) - F.expr("interval 12 days"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).withColumn("unknown", F.lit(1)), "clusters": stale["clusters"]}, backup)
    kinds = {"events": "id long, circuit string, start_ts string, cluster_id int", "clusters": "circuit string, cluster_id int", "hours": "circuit string"}
    tableset.restore(target, backup, kinds, {"events": ["circuit", "start_ts", "id"]})
    count = lambda name: target.read(name).groupBy("circuit").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "circuit", "n")
    rest = target.read("other").agg(F.count("*").alias("n")).select(F.lit("other").alias("name"), F.lit("kept").alias("circuit"), "n")
    return count("events").unionByName(count("clusters")).unionByName(count("hours")).unionByName(rest)


@query("""SELECT max(rowid) AS rowid, circuit, start_ts, CASE WHEN count(*) = 1 THEN max(cluster_id) END AS cluster_id, 1e0 AS hour_cos, CAST(NULL AS VARCHAR) AS match_level FROM (
 SELECT min(rowid) AS rowid, circuit, way, strftime(start_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS start_ts, arg_min(cluster_id, rowid) AS cluster_id FROM (SELECT id AS rowid, circuit, date_trunc('hour', start_ts) AS start_ts, id % 3 AS way, coalesce(cluster_id, 99) AS cluster_id FROM u) GROUP BY circuit, start_ts, way) GROUP BY circuit, start_ts""")
def dml16(spark, d):
    """Events of the oldest schema with times in three writings, as the newest schema has them: copies gone, times in UTC, new columns by default."""
    hour = F.date_trunc("hour", "start_ts")
    text = lambda shift: F.date_format(hour + F.expr(f"interval {shift} hours"), "yyyy-MM-dd'T'HH:mm:ss")
    way = F.when(F.col("id") % 3 == 0, F.concat(text(0), F.lit("Z"))).when(F.col("id") % 3 == 1, text(0)).otherwise(F.concat(text(-6), F.lit("-06:00")))
    old = usage_events(spark, d).select(F.col("id").alias("rowid"), F.col("id").cast("string").alias("id"), "circuit", way.alias("start_ts"), F.lit(None).cast("string").alias("end_ts"), F.coalesce("cluster_id", F.lit(99)).alias("cluster_id"))
    return migrations.migrated(old, "events", 0).select("rowid", "circuit", "start_ts", "cluster_id", "hour_cos", "match_level")
