"""Live subscriptions, day tables, meters and the life cycle against plain folds and replays."""

import hashlib
import json
import math
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import lifecycle, meters, storage
from tidewatch.sources import live

T0 = datetime(2024, 1, 1)
CHANGES = "seq long, n long, ts timestamp, entity_id string, state string, attributes map<string,string>"


def some_changes(n=400, seed=1):
    dice = random.Random(seed)
    rows = []
    for i in range(n):
        said = {k: str(dice.randint(0, 9)) for k in ("unit", "name") if dice.random() < 0.3}
        rows.append((i // 50, i, T0 + timedelta(seconds=i // 2), f"sensor.{dice.randint(0, 4)}", str(dice.randint(0, 99)) if dice.random() < 0.6 else None, said or None))
    return rows


def fold(rows, attributes):
    """The last value that was said, entity by entity."""
    now, out = {}, []
    for seq, n, ts, entity, state, said in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if state is None and not said:
            continue
        old = now.get(entity, [None] * (1 + len(attributes)))
        now[entity] = [new if new is not None else o for new, o in zip([state, *[(said or {}).get(a) for a in attributes]], old, strict=True)]
        out.append((entity, n, *now[entity]))
    return sorted(out)


def test_full_states_are_a_fold_of_the_diffs(spark, tmp_path):
    rows = some_changes()
    path = str(tmp_path / "sub")
    live.write_diffs(spark.createDataFrame(rows, CHANGES), path)
    got = live.full_states(live.subscribed(spark, path), ["unit", "name"]).select("entity_id", "n", "state", "unit", "name").collect()
    assert sorted(map(tuple, got)) == fold(rows, ["unit", "name"])
    two = live.subscribed(spark, path, ["sensor.1", "sensor.3"]).select("entity_id").distinct().collect()
    assert {r[0] for r in two} == {"sensor.1", "sensor.3"}


def test_messages_that_say_nothing_and_odd_values(spark, tmp_path):
    folder = tmp_path / "sub" / "seq=3"
    folder.mkdir(parents=True)
    good = {"ts": "2024-01-01T00:00:01+01:00", "n": 1, "c": {"a": {"+": {"s": "on", "a": {"x": 1.5, "y": None, "z": [1]}}}, "b": {"+": {}}, "d": {"-": {"a": ["x"]}}, "e": "?"}}
    lines = [json.dumps(good), "not json", "[]", "{}", '{"ts": "no time", "c": {"a": {"+": {"s": "1"}}}}', json.dumps({"ts": "2024-01-01T00:00:05", "n": 2, "c": {"a": {"+": {"s": 7}}}})]
    (folder / "part-0.txt").write_text("\n".join(lines))
    assert live.subscribed(spark, str(tmp_path / "sub")).count() == 0  # not finished
    (folder / "_SUCCESS").touch()
    got = sorted(tuple(r) for r in live.subscribed(spark, str(tmp_path / "sub")).select("seq", "n", F.date_format("ts", "HH:mm:ss"), "entity_id", "state", F.to_json("attributes")).collect())
    assert got == [(3, 1, "23:00:01", "a", "on", '{"x":"1.5","z":"[1]"}'), (3, 2, "00:00:05", "a", "7", "{}")]
    assert live.subscribed(spark, str(tmp_path / "none")).count() == 0


def test_stream_restart_and_rewind_store_each_change_once(spark, tmp_path):
    rows = some_changes(600)
    path, target, checkpoint = (str(tmp_path / n) for n in ("sub", "stored", "cp"))
    df = spark.createDataFrame(rows, CHANGES).where("state is not null or attributes is not null")
    said = df.count()
    run = lambda accept=None: live.store_changes(live.subscribed(spark, path, stream=True), target, checkpoint, accept).awaitTermination(120)
    live.write_diffs(df.where("seq < 4"), path)
    run(lambda batch, number: batch.where("n not in (120, 121, 130)"))
    assert spark.read.parquet(target).count() == df.where("seq < 4").count() - df.where("n in (120, 121, 130)").count()
    live.write_diffs(df.where("seq >= 4"), path)
    run()
    assert spark.read.parquet(target).where("n in (120, 121, 130)").count() == 0
    first_lost = T0 + timedelta(seconds=60)
    assert live.rewind(spark, path, first_lost) == 2
    run()
    run()
    stored = spark.read.parquet(target)
    assert stored.count() == said and stored.select("entity_id", "n").distinct().count() == said
    assert live.rewind(spark, path, T0 + timedelta(days=9)) is None


def test_merged_stream_equals_the_batch_and_a_rewind_repeats_nothing(spark, tmp_path):
    rows = some_changes(300, 4)
    path, out, checkpoint = (str(tmp_path / n) for n in ("sub", "out", "cp"))
    df = spark.createDataFrame(rows, CHANGES)
    for part in ("seq < 2", "seq between 2 and 4", "seq > 4"):
        live.write_diffs(df.where(part), path)
        merged = live.full_state_stream(live.subscribed(spark, path, stream=True), ["unit", "name"])
        merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        live.rewind(spark, path, T0 + timedelta(seconds=10))
    got = spark.read.parquet(out).select("entity_id", "n", "state", "unit", "name").collect()
    assert sorted(map(tuple, got)) == fold(rows, ["unit", "name"])


KIND = "key string, value double, seq long, day date"


def digests(path):
    return {str(p.relative_to(path)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def by_day(spark, days, value=1.0, seq=1, keys="abc"):
    return spark.createDataFrame([(k, value, seq, date(2024, 1, d)) for d in days for k in keys], KIND)


def test_upserts_leave_other_days_byte_for_byte(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.upsert_days(path, by_day(spark, range(1, 6)), ["key", "day"], KIND, "seq")
    before = digests(path)
    new = by_day(spark, [2, 9], 5.0, 2, "cd").unionByName(by_day(spark, [2], 7.0, 3, "d"))
    assert sorted(storage.upsert_days(path, new, ["key", "day"], KIND, "seq")) == [date(2024, 1, 2), date(2024, 1, 9)]
    after = digests(path)
    assert {p: h for p, h in before.items() if "day=2024-01-02" not in p} == {p: h for p, h in after.items() if "-02/" not in p and "-09/" not in p}
    got = {(r["key"], r["day"].day): r["value"] for r in storage.read_days(spark, path, KIND).collect()}
    assert len(got) == 15 + 1 + 2 and got["c", 2] == 5.0 and got["d", 2] == 7.0 and got["a", 2] == 1.0 and got["d", 9] == 5.0
    assert storage.upsert_days(path, by_day(spark, []), ["key", "day"], KIND, "seq") == []
    storage.add_days(path, by_day(spark, [2], 10.0).select("key", "value", "day"), ["key", "day"], "value", "key string, value double, day date")
    assert {r["key"]: r["value"] for r in spark.read.parquet(path).where("day = date'2024-01-02'").collect()} == {"a": 11.0, "b": 11.0, "c": 15.0, "d": 7.0}


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_days(by_day(spark, range(1, 6)), path)
    before = digests(path)
    bad = by_day(spark, [1, 2, 3]).withColumn("value", F.when(F.col("day") == date(2024, 1, 3), F.raise_error(F.lit("killed"))).otherwise(9.0).cast("double"))
    with pytest.raises(Exception, match="killed"):
        storage.write_days(bad, path)
    assert digests(path) == before
    assert storage.read_days(spark, path, KIND).agg(F.sum("value")).first()[0] == 15.0


def test_updates_are_held_to_the_allowed_fields(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_days(by_day(spark, [1, 2]), path)
    change = spark.createDataFrame([("a", 4.0, date(2024, 1, 1)), ("z", None, date(2024, 1, 1))], "key string, value double, day date")
    with pytest.raises(ValueError, match="value"):
        storage.update_days(path, change, ["key", "day"], KIND, ["seq"])
    storage.update_days(path, change, ["key", "day"], KIND, ["value"])
    assert {r["key"]: r["value"] for r in spark.read.parquet(path).where("day = date'2024-01-01'").collect()} == {"a": 4.0, "b": 1.0, "c": 1.0, "z": None}


def test_deletes_rewrite_only_days_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = by_day(spark, range(1, 8)).withColumn("seq", F.when((F.col("key") == "a") & (F.dayofmonth("day") == 3), 9).otherwise(F.dayofmonth("day")).cast("long"))
    storage.write_days(rows.unionByName(spark.createDataFrame([("n", 1.0, 0, None)], KIND)), path)
    before = digests(path)
    gone = storage.delete_days(spark, path, KIND, lambda r: r.where("seq >= 4 or seq < 2"), date(2024, 1, 5))
    after = digests(path)
    assert gone == 3 + 2
    assert not any("-02/" in p for p in after) and not (Path(path) / "day=2024-01-02").exists()
    assert {p: h for p, h in after.items() if "-03/" not in p} == {p: h for p, h in before.items() if "-02/" not in p and "-03/" not in p}
    assert storage.read_days(spark, path, KIND).count() == 22 - 5
    assert storage.delete_days(spark, str(tmp_path / "none"), KIND, lambda r: r, date(2024, 1, 5)) == 0


def replay_meter(rows):
    """Day and week figures reading by reading, with a stored baseline a day."""
    base, out = {}, []
    first = {}
    for circuit, i, ts, value in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        day = ts.date()
        if (circuit, day) not in first:
            first[circuit, day] = ts
            base[circuit, day] = value if ts - datetime.combine(day, datetime.min.time()) <= timedelta(hours=2) else 0.0
        week = day - timedelta(days=7)
        base.setdefault((circuit, week), 0.0)
        for period in ((circuit, day), (circuit, week)):
            if value < base[period]:
                base[period] = value
        out.append((circuit, i, max(0.0, value - base[circuit, day]), max(0.0, value - base[circuit, week])))
    return sorted(out)


def test_meters_equal_a_replay(spark):
    given = [("m", 1, T0 + timedelta(hours=1), 100.0), ("m", 2, T0 + timedelta(hours=3), 5.0), ("m", 3, T0 + timedelta(hours=4), 60.0)]
    schema = "circuit string, id long, ts timestamp_ntz, value double"
    assert [r["used_day"] for r in meters.day_usage(spark.createDataFrame(given, schema)).collect()] == [55.0]
    dice = random.Random(2)
    rows, t, v = [], 0, 50.0
    for i in range(900):
        t += dice.choice([60, 3600, 7200, 40000])
        v = dice.choice([v + dice.randint(0, 9), v + 1, 0.0 if dice.random() < 0.2 else v])
        rows.append((dice.choice("ab"), i, T0 + timedelta(seconds=t), float(v)))
    df = spark.createDataFrame([*rows, ("a", 10_000, T0, None)], schema)
    got = sorted((r["circuit"], r["id"], r["used_day"], r["used_week"]) for r in meters.running_usage(df).collect())
    want = replay_meter(rows)
    assert got == want
    last = {}
    for c, i, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        last[c, ts.date()] = i
    by_id = {(c, i): (a, b) for c, i, a, b in want}
    assert {(r["circuit"], r["day"]): (r["used_day"], r["used_week"]) for r in meters.day_usage(df).collect()} == {k: by_id[k[0], i] for k, i in last.items()}


def replay_training(commands, events, ends, label_days=7):
    """A clock that stops at each whole minute, command and event of one circuit; checks come before commands of the same time."""
    points = sorted([(t, 1, i, ("command", kind, days, least)) for i, t, kind, days, least in commands] + [(t, 2, i, ("event",)) for i, t in events])
    state, begun, count, over, least, done_at, changes = "idle", None, 0, None, 0, None, []
    minute, at = None, 0

    def to(new, t, command):
        nonlocal state, begun
        changes.append((t, new, command))
        state = new

    clock = math.floor(points[0][0] / 60) * 60 if points else 0
    while at < len(points) or clock <= ends:
        if at < len(points) and points[at][0] < clock:
            t, _, i, what = points[at]
            at += 1
            if what[0] == "event":
                count += state == "calibrating" and t > begun
                continue
            _, kind, days, minimum = what
            if kind == "stop":
                to("idle", t, i)
            elif kind == "recalibrate" or kind == "start" and state in ("idle", "labelling"):
                begun, count, over, least = t, 0, t + days * 86400, minimum
                to("calibrating", t, i)
            elif kind == "activate" and state == "labelling":
                to("live", t, i)
            continue
        # an event of this very minute is counted before the check
        while at < len(points) and points[at][0] == clock and points[at][3][0] == "event":
            count += state == "calibrating" and points[at][0] > begun
            at += 1
        same = [p for p in points[at:] if p[0] == clock and p[3][0] == "event"]
        extra = sum(state == "calibrating" and p[0] > begun for p in same)
        if state == "calibrating" and clock > begun and clock >= over and count + extra >= least:
            done_at = clock
            to("labelling", clock, None)
        elif state == "labelling" and clock >= done_at + label_days * 86400:
            to("live", clock, None)
        clock += 60
    return changes


@pytest.mark.parametrize("seed", [1])
def test_life_cycle_equals_a_clock(spark, seed):
    dice = random.Random(seed)
    commands, events, n = [], [], 0
    for c in "ab":
        for _ in range(14):
            n += 1
            t = dice.randint(0, 20 * 1440) * 60 + dice.choice([0, 0, 13, 59])
            commands.append((c, n, t, dice.choice(["start", "start", "stop", "activate", "activate", "recalibrate"]), dice.randint(0, 3), dice.choice([0, 2, 5, 30])))
        for _ in range(60):
            n += 1
            events.append((c, n, dice.randint(0, 20 * 86400)))
    commands.append(("never", 9001, 5, "activate", 0, 0))
    stamp = lambda t: T0 + timedelta(seconds=t)
    cdf = spark.createDataFrame([(c, i, stamp(t), k, d, m) for c, i, t, k, d, m in commands] + [(None, 9002, T0, "start", 1, 1), ("a", 9003, None, "start", 1, 1), ("a", 9004, T0, "other", 1, 1)], "circuit string, id long, ts timestamp_ntz, kind string, days int, minimum long")
    edf = spark.createDataFrame([(c, i, stamp(t)) for c, i, t in events], "circuit string, id long, ts timestamp_ntz")
    history = lifecycle.state_history(cdf, edf)
    got = {}
    for r in history.collect():
        got.setdefault(r["circuit"], []).append(((r["from_ts"] - T0).total_seconds(), r["state"], r["to_ts"] and (r["to_ts"] - T0).total_seconds(), r["events_collected"]))
    assert "never" not in got
    for c in "ab":
        shift = T0.timestamp() % 60
        assert shift == 0
        changes = replay_training([(i, t, k, d, m) for x, i, t, k, d, m in commands if x == c], [(i, t) for x, i, t in events if x == c], 40 * 86400)
        spans = []
        for (t, state, _), following in zip(changes, [*changes[1:], (None, None, None)], strict=True):
            if following[0] != t:
                spans.append((t, state, following[0], sum(t < e and (following[0] is None or e <= following[0]) for x, _, e in events if x == c) if state == "calibrating" else None))
        merged = []
        for s in sorted(got[c]):
            merged.append(s)
        same = lambda spans: [s for i, s in enumerate(spans) if not (s[1] in ("idle", "live") and i and spans[i - 1][1] == s[1])]  # noqa: E731  a stop in idle changes nothing
        assert [(a, s) for a, s, *_ in same(merged)] == [(a, s) for a, s, *_ in same([x for x in spans if not (x[1] == "idle" and x is spans[0])])]
        assert [x for x in merged if x[1] == "calibrating"] == [x for x in spans if x[1] == "calibrating"]
    rows = spark.createDataFrame([("a", 1, stamp(-5)), ("never", 2, stamp(5)), ("a", 3, stamp(40 * 86400))], "circuit string, id long, ts timestamp_ntz")
    states = {r["id"]: r["state"] for r in lifecycle.state_at(rows, history).collect()}
    assert states[1] == states[2] == "idle" and states[3] == max(got["a"])[1]


def test_life_cycle_without_commands_or_events(spark):
    none = spark.createDataFrame([], "circuit string, id long, ts timestamp_ntz, kind string, days int, minimum long")
    events = spark.createDataFrame([("a", 1, T0)], "circuit string, id long, ts timestamp_ntz")
    assert lifecycle.state_history(none, events).collect() == []
    one = spark.createDataFrame([("a", 1, T0, "start", 1, 1)], none.schema)
    got = lifecycle.state_history(one, events.limit(0)).collect()
    assert [(r["state"], r["to_ts"], r["events_collected"]) for r in got] == [("calibrating", None, 0)]


def test_passes_over_passes_read_the_source_a_few_times(spark, monkeypatch):
    from tidewatch import catalogue
    from tidewatch.operators import intervals
    from tidewatch.plans import sessions
    from tidewatch.sources import history

    read = []

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id")

    def counted(df, tag):
        read.append(scans(df))
        return history.kept(df, tag)

    for module in (intervals, sessions):
        monkeypatch.setattr(module, "kept", counted)
    for name, most in (("set02", 2), ("str02", 4)):
        read.clear()
        out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sum(read) + scans(out) <= most, name
