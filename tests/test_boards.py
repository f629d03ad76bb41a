"""Leak tests, valve travel and faults against sequential replays; table sets, migrations and presence against plain statements."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import leaktests, migrations, rules, tableset
from tidewatch.operators import relational as rel

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def replay_tests(commands, states, pressures):
    """One circuit, moment by moment."""
    out, now = [], {"open_stop": False, "closed_stop": False, "fault": False}
    points = sorted([(t, 0, i, ("state", role, on)) for i, t, role, on in states] + [(t, 1, i, ("command", kind, minutes)) for i, t, kind, minutes in commands] + [(t, 2, i, ("pressure", p, d)) for i, t, p, d in pressures])
    test, last = None, None
    for t, _, i, what in points:
        if what[0] == "state":
            now[what[1]] = what[2]
        elif what[0] == "command" and what[1] == "run":
            if test is None:
                if now["closed_stop"] or not now["open_stop"]:
                    out.append([i, t, 6, t, None])
                elif now["fault"]:
                    out.append([i, t, 7, t, None])
                else:
                    test = {"row": [i, t, None, None, last], "begin": t + 60, "over": t + 60 + what[2] * 60}
                    out.append(test["row"])
        elif what[0] == "command" and test is not None:
            test["row"][2:4] = [5, t]
            test = None
        elif what[0] == "pressure":
            if test is not None and t <= test["begin"]:
                test["row"][4] = what[1]
            if test is not None and t >= test["begin"]:
                base = test["row"][4]
                drop = None if base is None else base - what[1]
                r = 4 if drop is not None and drop < -3 else 9 if what[2] > 10 else 3 if drop is not None and drop > 3 else 2 if t >= test["over"] else None
                if r:
                    test["row"][2:4] = [r, t]
                    test = None
            last = what[1]
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", [0])
def test_leak_tests_equal_a_replay(spark, seed):
    dice = random.Random(seed)
    commands, states, pressures, n = [], [], [], 0
    times = iter(dice.sample(range(3 * 86400), 3000))
    for c in "ab":
        for _ in range(60):
            n += 1
            commands.append((c, n, next(times), dice.choice(["run", "run", "run", "stop"]), dice.choice([1, 10, 60, 300])))
        for _ in range(60):
            n += 1
            role = dice.choice(["open_stop", "closed_stop", "fault"])
            states.append((c, n, next(times), role, dice.random() < {"open_stop": 0.9, "closed_stop": 0.2, "fault": 0.2}[role]))
        for _ in range(700):
            n += 1
            pressures.append((c, n, next(times), 40 + dice.choice([0.0, 0.5, 1.0, 2.0, -2.5, 3.5]), dice.choice([0.0] * 30 + [11.0])))
    cdf = spark.createDataFrame([(c, i, at(t), k, m) for c, i, t, k, m in commands] + [(None, 9999, T0, "run", 1)], "circuit string, id long, ts timestamp_ntz, kind string, minutes int")
    sdf = spark.createDataFrame([(c, i, at(t), r, on) for c, i, t, r, on in states], "circuit string, id long, ts timestamp_ntz, role string, is_on boolean")
    pdf = spark.createDataFrame([(c, i, at(t), p, d) for c, i, t, p, d in pressures], "circuit string, id long, ts timestamp_ntz, pressure double, drop_5s double")
    got = leaktests.leak_test_history(cdf, sdf, pdf).collect()
    seconds = lambda ts: None if ts is None else round((ts - T0).total_seconds())
    seen = set()
    for c in "ab":
        own = sorted((r["id"], seconds(r["started_at"]), r["result"], seconds(r["ended_at"]), r["baseline"]) for r in got if r["circuit"] == c)
        want = replay_tests(*[[x[1:] for x in rows if x[0] == c] for rows in (commands, states, pressures)])
        assert own == want
        seen |= {r[2] for r in own}
    assert seen >= {2, 3, 4, 5, 6, 7}
    assert leaktests.leak_test_history(cdf.limit(0), sdf, pdf).collect() == []


def test_valves_that_travel_too_long(spark):
    commands = spark.createDataFrame([("a", 1, at(0), "open"), ("a", 2, at(100), "close"), ("a", 3, at(105), "open"), ("a", 4, at(200), "open"), ("a", 5, at(300), "close"), ("b", 6, at(0), "open")], "circuit string, id long, ts timestamp_ntz, kind string")
    stops = spark.createDataFrame([("a", 1, at(15), "open_stop", True), ("a", 2, at(101), "open_stop", False), ("a", 3, at(300), "open_stop", True), ("a", 4, at(316), "closed_stop", True), ("b", 9, at(-5), "open_stop", True)], "circuit string, id long, ts timestamp_ntz, role string, is_on boolean")
    got = sorted((r["circuit"], r["id"], (r["ts"] - T0).total_seconds()) for r in leaktests.travel_faults(commands, stops).collect())
    assert got == [("a", 3, 120.0), ("a", 4, 215.0), ("a", 5, 315.0)]


def test_faults_stay_until_a_reset(spark):
    triggers = spark.createDataFrame([("a", 1, at(5), "burst"), ("a", 2, at(6), "leak"), ("a", 3, at(9), "motor"), ("a", 4, at(20), "leak"), ("b", 5, at(1), "burst")], "circuit string, id long, ts timestamp_ntz, reason string")
    resets = spark.createDataFrame([("a", 6, at(9)), ("a", 7, at(10)), ("c", 8, at(1))], "circuit string, id long, ts timestamp_ntz")
    got = sorted((r["circuit"], (r["ts"] - T0).total_seconds(), r["is_on"], r["reason"]) for r in leaktests.fault_history(triggers, resets).collect())
    assert got == [("a", 5.0, True, "burst"), ("a", 6.0, True, "burst"), ("a", 9.0, False, None), ("a", 9.0, True, "burst"), ("a", 10.0, False, None), ("a", 20.0, True, "leak"), ("b", 1.0, True, "burst"), ("c", 1.0, False, None)]


EVENTS = "id string, circuit string, start_ts string, cluster_id int"
CLUSTERS = "circuit string, cluster_id int"


def a_backup(path, events, clusters=None):
    for name, rows in (("events", events), ("clusters", clusters)):
        if rows is not None:
            (path / name).mkdir(parents=True)
            (path / name / "part-0.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def contents(target, name):
    return sorted((tuple(r) for r in target.read(name).collect()), key=str)


def test_restore_of_all_tables_or_none(spark, tmp_path):
    target = tableset.TableSet(spark, str(tmp_path / "set"))
    assert target.state() == tableset.State()
    target.commit({"events": spark.createDataFrame([("old", "x", "2020-01-01T00:00:00+00:00", 1)], EVENTS), "clusters": spark.createDataFrame([("x", 1)], CLUSTERS), "other": spark.range(3)}, 22)
    events = [{"id": "1", "circuit": "m", "start_ts": "2024-01-01T06:00:00+00:00", "extra": 9}, {"id": "2", "circuit": "m", "start_ts": "2024-01-01T00:00:00-06:00", "cluster_id": 4}, {"id": "3", "circuit": "m"}]
    kinds = {"events": EVENTS, "clusters": CLUSTERS}
    bad = a_backup(tmp_path / "bad", events, ['{"circuit": "m", "cluster_id": 5}', '{"circuit": "m", "clus'])
    before = target.state()
    with pytest.raises(Exception):  # noqa: B017, PT011  whatever Spark raises for a broken line
        tableset.restore(target, bad, kinds, {"events": ["circuit", "start_ts"]})
    assert target.state() == before and contents(target, "events")[0][0] == "old" and contents(target, "clusters") == [("x", 1)]
    assert len([p for p in (tmp_path / "set").iterdir() if p.is_dir()]) == 3
    good = a_backup(tmp_path / "good", events)
    assert tableset.restore(target, good, kinds, {"events": ["circuit", "start_ts"]}) == {"events": 2, "clusters": 0}
    assert contents(target, "events") == [("2", "m", "2024-01-01T06:00:00+00:00", 4), ("3", "m", None, None)]
    assert contents(target, "clusters") == [] and target.read("other").count() == 3 and target.state().version == 22
    assert target.sweep() == 3 and target.read("other").count() == 3


def test_two_commits_of_one_number(spark, tmp_path):
    target = tableset.TableSet(spark, str(tmp_path / "set"))
    target.commit({"a": spark.range(1)})
    old = target.state()
    target.state = lambda: old  # a second writer that has not seen the change below
    tableset.TableSet(spark, str(tmp_path / "set")).commit({"a": spark.range(2)})
    with pytest.raises(RuntimeError, match="another change"):
        target.commit({"a": spark.range(3)})
    assert tableset.TableSet(spark, str(tmp_path / "set")).read("a").count() == 2


def test_archive_there_and_back(spark, tmp_path):
    source, target = (tableset.TableSet(spark, str(tmp_path / n)) for n in ("one", "two"))
    source.commit({"events": spark.createDataFrame([("1", "m", "t", 1), ("2", "m", "u", 2)], EVENTS), "hours": spark.range(4)}, 21)
    tableset.export_archive(source, ["events", "hours", "none"], str(tmp_path / "arc"), "2024-01-20T00:00:00")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "arc" / "_archive_meta")).collect()} == {("backup_type", "history_archive"), ("version", "21"), ("exported_at", "2024-01-20T00:00:00")}
    target.commit({"events": spark.createDataFrame([("1", "m", "t", 7)], EVENTS), "clusters": spark.createDataFrame([("m", 1)], CLUSTERS)})
    assert tableset.merge_archives(target, str(tmp_path / "arc"), {"events": ["id"], "clusters": ["circuit"], "hours": ["id"]}) == {"events": 1}
    assert contents(target, "events") == [("1", "m", "t", 7), ("2", "m", "u", 2)] and contents(target, "clusters") == [("m", 1)]


def test_tables_of_old_versions_read_alike(spark, tmp_path):
    old = spark.createDataFrame([(1, "x", "main", "2024-01-01T06:00:00", "2024-01-01T06:01:00", 3), (2, "y", "main", "2024-01-01T00:00:00-06:00", "2024-01-01T00:01:00-06:00", 4), (3, "z", "main", "no time", None, 5)], "rowid long, id string, circuit string, start_ts string, end_ts string, cluster_id int")
    ages = {0: old, 9: migrations.migrated(old, "events", 0, 9), 14: migrations.migrated(old, "events", 0, 14)}
    read = {v: migrations.migrated(rows, "events", v) for v, rows in ages.items()}
    assert len({tuple(df.columns) for df in read.values()}) == 1
    rows = {v: sorted(tuple(str(x) for x in r) for r in df.collect()) for v, df in read.items()}
    assert rows[0] == rows[9] == rows[14] and len(rows[0]) == 2
    kept = {r["rowid"]: r for r in read[0].collect()}
    assert kept[2]["start_ts"] == "2024-01-01T06:00:00+00:00" and kept[2]["cluster_id"] is None and kept[2]["hour_cos"] == 1.0 and kept[3]["cluster_id"] == 5 and kept[3]["id"] == "z"
    years = spark.createDataFrame([(3, 3), (3, 2), (5, 3)], "events_retain_years int, hourly_volume_retain_years int")
    assert sorted((r[0], r[1]) for r in migrations.migrated(years, "data_retention", 0).collect()) == [(1, 2), (3, 2), (5, 3)]
    profile = migrations.migrated(spark.range(1), "home_profile", 0)
    assert "monthly_budget_litres" not in profile.columns and "away_until" not in profile.columns and profile.first()["flow_unit"] == "L/min"
    with pytest.raises(ValueError, match="newer"):
        migrations.migrated(old, "events", 99)
    target = tableset.TableSet(spark, str(tmp_path / "set"))
    target.commit({"events": old, "data_retention": years}, 0)
    assert tableset.migrate(target)[0] == 1 and target.state().version == migrations.LATEST and tableset.migrate(target) == []
    assert target.read("events").count() == 2 and Path(tmp_path / "set").exists()


def test_presence_of_three_values(spark):
    rows = spark.createDataFrame([("a", "not_home"), ("a", None), ("a", ""), ("b", "not_home"), ("b", "work"), ("c", "work"), ("c", "home"), ("d", ""), ("e", "unknown")], "circuit string, state string")
    assert {r[0]: r[1] for r in rules.presence(rows).collect()} == {"a": True, "b": None, "c": False, "d": None, "e": None}
    says = [("p", "not_home"), ("q", "home"), ("p", ""), ("q", "not_home"), ("z", "home"), ("q", "work"), ("p", "not_home"), ("q", "home")]
    df = spark.createDataFrame([("k", i, at(i), e, s) for i, (e, s) in enumerate(says)], "key string, id long, ts timestamp_ntz, entity string, state string")
    out = rules.away_history(df, "key", "entity", ["p", "q"], ["ts", "id"]).orderBy("id").collect()
    assert [r["away"] for r in out] == [True, False, False, True, True, True, True, False]
    assert [r["toggled"] for r in out] == [True, True, False, True, False, False, False, True]


@pytest.mark.parametrize(("n_centers", "block"), [(3000, 16), (20_000, 256)])
def test_nearest_center_beyond_any_broadcast(spark, n_centers, block):
    dice = np.random.default_rng(n_centers)
    centers = np.round(np.concatenate([dice.normal(0, 1, (n_centers // 2, 6)), dice.normal(5, 0.01, (n_centers // 2, 6))]), 3)
    points = np.round(np.concatenate([dice.normal(0, 1, (60, 6)), dice.normal(5, 1, (20, 6)), centers[:10], centers[-10:]]), 3)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centers)], "center_id long, c array<double>")
    pdf = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(points)] + [(999, None, "x")], "id long, v array<double>, center_name string")
    found = rel.nearest_by_pivots(pdf, cdf, "v", "c", pivots=32, block=block) if n_centers < 4096 else rel.nearest_center(pdf, cdf, "v", "c")
    got = {r["id"]: (r["center_id"], r["distance"]) for r in found.collect()}
    assert len(got) == 101 and got[999] == (None, None)
    for i, v in enumerate(points):
        d = np.sqrt(((centers - v) ** 2).sum(axis=1))
        assert got[i][1] == pytest.approx(d.min(), abs=1e-9) and d[got[i][0]] == pytest.approx(d.min(), abs=1e-9)
