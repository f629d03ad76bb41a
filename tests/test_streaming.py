"""Streams give what the batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.sources.history import read_backup, usage_events
from tidewatch.streaming import live_state, notices, rollup
from tidewatch.streaming.detector import detect, detect_stream

T0 = datetime(2024, 1, 1)


def scripted(spark):
    """Readings of two circuits: a flow event, an onset event with late flow, noise under the limit, and a reset."""
    rows, n = [], 0

    def add(circuit, seconds, role, state):
        nonlocal n
        n += 1
        rows.append((circuit, n, T0 + timedelta(seconds=seconds), role, state))

    for c, shift in (("main", 0), ("garden", 7)):
        for s in range(400):
            add(c, s + shift, "flow", "6.5" if 50 <= s < 80 or 200 <= s < 202 else "0")
            add(c, s + shift + 0.25, "pressure", "40" if not 60 <= s < 70 else "50")
        add(c, 300 + shift + 0.1, "onset", "on")
        add(c, 310 + shift + 0.1, "onset", "off")
    add("main", 399.9, "flow", "unavailable")
    return spark.createDataFrame(rows, "circuit string, id long, ts timestamp, role string, state string")


def test_detector_stream_is_batch(spark, tmp_path):
    readings = scripted(spark)
    want = sorted(map(tuple, detect(readings).collect()))
    assert len(want) == 4 and {r[3] for r in want} == {"flow", "onset"}
    assert {round((r[2] - r[1]).total_seconds()) for r in want} == {30, 10}
    path = str(tmp_path / "in")
    for i, (low, high) in enumerate([(0, 150), (150, 305), (305, 1000)]):
        cut = readings.where((F.unix_seconds("ts") >= T0.timestamp() + low) & (F.unix_seconds("ts") < T0.timestamp() + high))
        cut.coalesce(1).write.mode("append").parquet(path)
        assert i < 3
    got = []
    stream = rollup.reading_stream(spark, path, readings.schema)
    query = rollup.store(detect_stream(stream), lambda batch, n: got.extend(map(tuple, batch.collect())), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(got) == want


def test_hourly_stream_and_idempotent_storage(spark, tmp_path):
    events = usage_events(spark, "/root/testdata/sf0.001").withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    path = str(tmp_path / "in")
    events.coalesce(2).write.parquet(path)
    stream = rollup.reading_stream(spark, path, events.schema)
    out = stream.groupBy("circuit", F.window("start_ts", "1 hour")).agg(F.sum("volume_litres").alias("volume"))
    query = out.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert abs(spark.table("hours").agg(F.sum("volume")).first()[0] - events.agg(F.sum("volume_litres")).first()[0]) < 1e-6
    assert rollup.hourly_stream(stream).isStreaming and rollup.session_stream(stream.withColumnRenamed("start_ts", "ts").withColumn("value", F.lit(1.0))).isStreaming

    for prune in (None, "start_ts"):
        target = str(tmp_path / f"stored-{prune}")
        for cp in ("c2", "c3"):  # the second run reads everything again
            rollup.store(rollup.distinct_events(stream), rollup.append_new(target, ["circuit", "start_ts"], prune), str(tmp_path / f"{cp}-{prune}")).awaitTermination(120)
        stored = spark.read.parquet(target)
        assert stored.count() == events.select("circuit", "start_ts").distinct().count()


def test_backup_round_trip(spark, tmp_path):
    path = tmp_path / "backup.json"
    path.write_text('{"version": 3, "tables": {"events": [{"id": 1, "circuit": "main", "extra": 5}, {"id": 2}], "empty": []}}')
    rows = read_backup(spark, str(path), "events", "id long, circuit string, note string").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "main", None), (2, None, None)]
    assert read_backup(spark, str(path), "empty", "id long").count() == 0
    assert read_backup(spark, str(path), "missing", "id long").count() == 0


def test_live_state_stream_is_batch_whatever_the_order(spark, tmp_path):
    import random

    dice = random.Random(6)
    rows = [(dice.choice(["main", "garden", None]), i, T0 + timedelta(seconds=dice.randint(0, 4000)), dice.choice([*live_state.ROLES, "other"]), dice.choice(["on", "off", "1.5", None, "unknown"])) for i in range(600)]
    readings = spark.createDataFrame(rows, "circuit string, id long, ts timestamp, role string, state string")
    want = {r["circuit"]: r for r in live_state.latest_roles(readings, {"flow": 30, "valve": 100_000, "volume": 0}).collect()}
    path = str(tmp_path / "in")
    dice.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], readings.schema).coalesce(1).write.mode("append").parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = live_state.role_stream(rollup.reading_stream(spark, path, readings.schema, 1), {"flow": 30, "valve": 100_000, "volume": 0})
        got = {}
        query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: got.update({r["circuit"]: r for r in batch.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.unset(provider)
    assert got.keys() == want.keys() == {"main", "garden"}
    assert all(tuple(got[c]) == tuple(want[c]) for c in want)
    assert any(want[c]["flow"] is None for c in want)


def test_hourly_and_session_streams_give_closed_windows_of_the_batch(spark, tmp_path):
    seconds = [0, 5, 15, 31, 100, 3700, 3710, 7300, 20_000, 40_000]
    rows = [("a", i, T0 + timedelta(seconds=s), 1.0 + i) for i, s in enumerate(seconds)] + [("b", 99, T0 + timedelta(seconds=40_000), 0.01)]
    df = spark.createDataFrame(rows, "circuit string, id long, ts timestamp, value double")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    run = lambda stream, name: stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    stream = rollup.reading_stream(spark, path, df.schema)
    run(rollup.session_stream(stream), "sessions")
    at = lambda s: T0 + timedelta(seconds=s)
    got = sorted((r["start_ts"], r["end_ts"], r["n"]) for r in spark.table("sessions").collect())
    assert got == [(at(0), at(15), 3), (at(31), at(31), 1), (at(100), at(100), 1), (at(3700), at(3710), 2), (at(7300), at(7300), 1), (at(20_000), at(20_000), 1)]
    run(rollup.hourly_stream(stream.withColumnsRenamed({"ts": "start_ts", "value": "volume_litres"})), "hourly")
    assert {(r["hour_ts"], r["volume"]) for r in spark.table("hourly").collect()} == {(at(0), 15.0), (at(3600), 13.0), (at(7200), 8.0), (at(18_000), 9.0)}


def test_a_notice_is_sent_once_per_change_and_a_batch_run_again_sends_nothing(spark, tmp_path):
    kind = "circuit string, alert_type string, active boolean, title string, message string, critical boolean, ts timestamp"
    path, box, checkpoint = (str(tmp_path / n) for n in ("in", "box", "cp"))
    config = spark.createDataFrame([("a", "trickle", False), ("b", "trickle", True)], "circuit string, alert_type string, enabled boolean")

    def say(*rows):
        spark.createDataFrame([(c, k, on, k.title(), f"{k} of {c} é", crit, T0 + timedelta(seconds=s)) for c, k, on, crit, s in rows], kind).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = notices.changed(rollup.reading_stream(spark, path, spark.read.parquet(path).schema))
        notices.send(notices.addressed(stream, config, "phone, tablet"), box, checkpoint).awaitTermination(120)
        return sorted((r["circuit"], r["alert_type"], r["target"] or "", r["ts"].second) for r in notices.sent(spark, box).collect())

    three = lambda c, k, s: [(c, k, t, s) for t in ("", "phone", "tablet")]
    say(("a", "burst", True, True, 1), ("a", "burst", True, True, 2), ("a", "trickle", True, False, 3), ("b", "trickle", False, False, 4))
    assert run() == three("a", "burst", 1)
    assert run() == three("a", "burst", 1)
    say(("a", "burst", True, True, 5), ("b", "trickle", True, False, 6), ("b", "trickle", True, False, 2), ("c", "other", False, False, 7))
    assert run() == sorted(three("a", "burst", 1) + three("b", "trickle", 6))
    last = max((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for gone in (last, last.with_name(f".{last.name}.crc")):  # the driver was lost after the batch was sent, before Spark noted it
        gone.unlink(missing_ok=True)
    assert run() == sorted(three("a", "burst", 1) + three("b", "trickle", 6))
    assert list((tmp_path / "box" / "_staged").iterdir()) == []
    say(("a", "burst", False, True, 8), ("a", "burst", True, True, 9))
    assert run() == sorted(three("a", "burst", 1) + three("b", "trickle", 6) + three("a", "burst", 9))
