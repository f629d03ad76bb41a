"""Operators against literal folds on random and edge inputs."""

import random
import uuid
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import curves, scalars
from tidewatch.operators import clustering, intervals, series
from tidewatch.plans import sessions

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_coalesce_equals_a_fold(spark):
    rng = random.Random(1)
    rows = []
    for key in "ab":
        t = 0
        for _ in range(300):
            t += rng.choice([1, 14, 15, 16, 40, 20000])
            rows.append((key, len(rows), at(t), at(t + rng.choice([0, 5, 60]))))
    want = []
    for key in "ab":
        spans = sorted((s, e) for k, _, s, e in rows if k == key)
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1] + timedelta(seconds=15):
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(key, *m) for m in merged]
    df = spark.createDataFrame(rows, "circuit string, id long, s timestamp_ntz, e timestamp_ntz")
    got = intervals.coalesce_intervals(df, "circuit", "s", "e", "id", 15.0)
    assert sorted((r[0], r["s"], r["e"]) for r in got.collect()) == sorted(want)


def test_frames_across_blocks_and_buckets(spark):
    rng = random.Random(2)
    rows = [("k", i, at(i * 613), float(rng.randrange(100))) for i in range(500)]
    df = spark.createDataFrame(rows, "circuit string, id long, ts timestamp_ntz, v double").repartition(5)
    out = series.framed(df, "circuit", ["ts", "id"], {"m": ("avg", "v", -9, -3)}, bucket=3600, block=32)
    got = {r["id"]: r["m"] for r in out.collect()}
    for i in range(len(rows)):
        part = [r[3] for r in rows[max(0, i - 9) : max(0, i - 2)]]
        assert (got[i] is None) == (not part) and (not part or abs(got[i] - np.mean(part)) < 1e-9)
    before = series.previous(df, "circuit", ["ts", "id"], {"p": "v"}, bucket=3600)
    assert all(r["p"] == (rows[r["id"] - 1][3] if r["id"] else None) for r in before.collect())


def test_identifiers_and_curves(spark):
    names = ["main/2024-01-01T00:00:00.000000+00:00", "é", ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(scalars.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]
    arrays = {"unknown": [1.0] * 9, "steady": [5.0] * 30, "rising": [float(i) for i in range(20, 60)], "falling": [float(i) for i in range(60, 20, -1)], "pulsed": [0.1, 9.0] * 20}
    rows = spark.createDataFrame(list(arrays.items()), "want string, a array<double>").select("want", curves.curve_shape(F.col("a")).alias("got"), curves.array_stats(F.col("a"))["stdev"].alias("sd")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    assert all(abs(r["sd"] - np.std(arrays[r["want"]], ddof=1)) < 1e-9 for r in rows)
    ema = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>").select(curves.last_ema(F.col("a"))).first()[0]
    assert np.isclose(ema, 1.56)
    assert [r[0] for r in spark.createDataFrame([("3.5.1 (x)",), ("3.4",), (None,), ("v4",)], "v string").select(scalars.version_at_least(F.col("v"), (3, 5, 1))).collect()] == [True, False, True, True]


def test_sessions_from_readings(spark):
    rows = []
    for s in range(0, 300):
        rows.append(("main", len(rows), at(s), "flow", "6" if 40 <= s < 60 or 70 <= s < 80 or 200 <= s <= 201 else "unavailable"))
        rows.append(("main", len(rows), at(s), "pressure", "50" if s < 40 else "45"))
    rows += [("main", 9001, at(41), "volume", "100.0"), ("main", 9002, at(78), "volume", "103.5")]
    readings = spark.createDataFrame(rows, "circuit string, id long, ts timestamp_ntz, role string, state string")
    none = spark.createDataFrame([], "circuit string, start_ts timestamp_ntz")
    (event,) = sessions.reconstructed_events(readings, none).collect()  # the second run is under 3 s, the gap of 11 s merges
    assert (event["start_ts"], event["end_ts"]) == (at(40), at(80))  # a run goes to the reading that ends it
    assert event["start_trigger"] == "flow" and event["has_pressure_transient"] and event["pressure_delta_psi"] == 4.84 and event["peak_flow_lpm"] == 6.0
    late = sessions.reconstructed_events(readings.where("role <> 'pressure' or ts >= timestamp_ntz'2024-01-01 00:00:41'").withColumn("state", F.when((F.col("role") == "pressure") & (F.second("ts") == 50), "44.4").otherwise(F.col("state"))), none)
    (first,) = late.collect()  # without a pressure before the start the first three since are the baseline
    assert (first["pre_event_pressure_psi"], first["min_pressure_psi"], first["pressure_delta_psi"], first["has_pressure_transient"]) == (45.0, 44.4, 0.6, False)
    assert sessions.reconstructed_events(readings.where("role <> 'pressure'"), none).first()["pre_event_pressure_psi"] == 0.0
    assert sessions.reconstructed_events(readings.where("role <> 'flow'"), none).count() == 0  # an onset alone, or none, is no event
    assert event["volume_litres_measured"] == 3.5 and event["min_pressure_psi"] == 45 and event["pre_event_pressure_psi"] > 49
    stored = spark.createDataFrame([("main", at(70))], "circuit string, start_ts timestamp_ntz")
    assert sessions.reconstructed_events(readings, stored).count() == 0
    raw = spark.createDataFrame([("main", at(0), at(60), [6.0] * 60, [50.0] * 2400, 55.0, 50.0, True, None, "flow", False)], "circuit string, start_ts timestamp_ntz, end_ts timestamp_ntz, flow_readings array<double>, pressure_readings array<double>, pre_event_pressure_psi double, min_pressure_psi double, has_pressure_transient boolean, volume_litres_measured double, start_trigger string, is_composite boolean")
    out = sessions.event_features(raw).first()
    assert (out["volume_litres"], out["resistance_curve_shape"], out["hydraulic_resistance"]) == (6.0, "steady", round(5 / 6, 4))


def test_learner_finds_blobs(spark):
    rng = np.random.default_rng(3)
    centers = [(0.0, 0.0), (20.0, 0.0), (0.0, 20.0)]
    rows = [("main" if i < 150 else "garden", i, at(i), *(float(v) for v in np.array(centers[i % 3]) + rng.normal(0, 0.3, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "circuit string, id long, end_ts timestamp_ntz, x double, y double")
    got = {r["id"]: (r["circuit"], r["learned_id"]) for r in clustering.learn_clusters(df, ["x", "y"]).collect()}
    again = {r["id"]: (r["circuit"], r["learned_id"]) for r in clustering.learn_clusters(df.repartition(7), ["x", "y"]).collect()}
    assert got == again and len(got) == 300
    assert len({got[i] for i in range(150)}) == 3 and all(got[i] == got[i % 3] for i in range(150))


def test_detector_in_batches_equals_one_machine(spark):
    """All three triggers and gaps, many circuits and batches, against the machine fed with one sorted list."""
    from tidewatch.streaming.detector import Circuit, detect

    rng = random.Random(12)
    rows = []
    for circuit in ("a", "b", "c"):
        t = 0.0
        for i in range(6000):
            t += rng.choice([0.1, 0.5, 1.0])
            role = rng.choices(["flow", "pressure", "onset", "reset"], [3, 12, 1, 0.01])[0]
            busy = int(t) % 200 < 40
            state = {"flow": str(rng.choice([4.0, 6.5]) if busy else 0), "pressure": str(round(50 - (9 if busy else 0) + rng.random(), 2)), "onset": "on" if busy else "off", "reset": "unavailable"}[role]
            rows.append((circuit, i, at(t), role, state if rng.random() > 0.01 else "unknown"))
    df = spark.createDataFrame(rows, "circuit string, id long, ts timestamp_ntz, role string, state string").repartition(7)
    want = []
    for circuit in ("a", "b", "c"):
        machine = Circuit(2.0, 3.0)
        for _, i, ts, role, state in sorted((r for r in rows if r[0] == circuit), key=lambda r: (r[2], r[3], r[1])):
            found = machine.read((ts - datetime(1970, 1, 1)).total_seconds(), role, state)
            if found:
                want.append((circuit, found["start_trigger"], found["has_pressure_transient"], found["is_composite"], found["n_flow"], round(found["end"] - found["start"], 3)))
    got = [(r.circuit, r.start_trigger, r.has_pressure_transient, r.is_composite, r.n_flow, round((r.end_ts - r.start_ts).total_seconds(), 3)) for r in detect(df).collect()]
    assert sorted(got) == sorted(want) and len({w[1] for w in want}) >= 2 and any(w[2] for w in want)


def test_learned_groups_take_stored_clusters(spark):
    learned = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 9.0, 9.0), ("b", 0, 1.0, 1.0)], "circuit string, learned_id long, x double, y double")
    stored = spark.createDataFrame([("a", 5, "toilet", 0.5, 0.0), ("a", 6, "toilet", 0.7, 0.0), ("a", 7, None, 0.0, 2.0), ("b", 8, "toilet", 0.0, 0.0)], "circuit string, cluster_id long, suggested_type string, x double, y double")
    got = {(r.circuit, r.learned_id): r.cluster_id for r in clustering.remapped(learned, stored, ["x", "y"]).collect()}
    assert got == {("a", 0): 5, ("a", 1): None, ("b", 0): None}


def test_upkeep_edges(spark):
    import pytest

    from tidewatch.operators import upkeep

    row = spark.createDataFrame([(1.0,)], "pressure_drop double")
    with pytest.raises(ValueError, match="unknown settings: nope"):
        upkeep.updated_singleton(row, {"nope": 1}, row.columns)
    tests = spark.createDataFrame([(1, at(0), 1, 50.0), (2, at(0), 1, None)], "test_id long, run_at timestamp_ntz, minutes int, baseline double")
    polls = spark.createDataFrame([(1, at(100), "In progress", 49.0), (1, at(239), upkeep.TEST_RESULTS[1], 47.5), (1, at(500), upkeep.TEST_RESULTS[0], 40.0), (2, at(240), upkeep.TEST_RESULTS[0], 1.0)], "test_id long, ts timestamp_ntz, result string, pressure double")
    got = {r.test_id: (r.result, r.duration_minutes, r.pressure_drop, r.passed) for r in upkeep.test_reports(tests, polls).collect()}
    assert got == {1: (upkeep.TEST_RESULTS[1], 4.0, 2.5, False), 2: (upkeep.TIMED_OUT, 4.0, None, False)}
    assert len(upkeep.role_patterns()) == 28
