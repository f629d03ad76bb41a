"""Leak tests from the command to the result, and the faults that stay until they are reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.intervals import as_of
from tidewatch.operators.lifecycle import first_from, took_effect
from tidewatch.operators.rules import LEAK_RESULTS
from tidewatch.operators.series import numbered, running, seconds
from tidewatch.sources.history import kept

#: Seconds that the pressure settles in before the baseline is taken, and that a valve may travel.
SETTLE, TRAVEL = 60, 15


def first_beyond(runs: DataFrame, pressures: DataFrame, threshold: float, rapid: float, fan: int = 64) -> DataFrame:
    """(id, beyond): the first reading (t, pid, r) of each run from begin on that ends it by its pressure, with the result; runs that none ends are left out.

    runs: (circuit, id, begin, baseline); pressures: (circuit, id, ts, pressure, drop_5s). Readings are numbered, and ``fan`` of them are one node with the
    largest and least pressure and the largest drop, ``fan`` nodes one of the next level, and so on. A run looks through the rest of its node, then through the
    rest of the node above, until one holds such a reading, and down again: it meets twice as many nodes as there are levels, however long it lasts.
    """
    at = numbered(pressures, "circuit", ["ts", "id"], "pos").withColumn("n", F.col("pos") - 1)
    group = F.floor(F.col("n") / fan).alias("g")
    leaf = F.struct("n", F.col("pressure").alias("hi"), F.col("pressure").alias("lo"), F.col("drop_5s").alias("drop"), seconds(F.col("ts")).alias("t"), F.col("id").alias("pid"))
    levels = [kept(at.groupBy("circuit", group).agg(F.array_sort(F.collect_list(leaf)).alias("own")), "nodes")]
    while levels[-1].where("g > 0").limit(1).count():
        of = lambda c: F.transform("own", lambda x: x[c])
        node = F.struct(F.col("g").alias("n"), F.array_max(of("hi")).alias("hi"), F.array_min(of("lo")).alias("lo"), F.array_max(of("drop")).alias("drop"))
        nodes = levels[-1].select("circuit", node.alias("x"))
        levels.append(kept(nodes.groupBy("circuit", F.floor(F.col("x.n") / fan).alias("g")).agg(F.array_sort(F.collect_list("x")).alias("own")), "nodes"))

    def result(x: Column) -> Column:
        base = F.col("baseline")
        return F.when(-(base - x["hi"]) > threshold, LEAK_RESULTS["pressure_rose"]).when(x["drop"] > rapid, LEAK_RESULTS["rapid_drop"]).when(base - x["lo"] > threshold, LEAK_RESULTS["failed"])

    def looked(own: DataFrame, level: int) -> DataFrame:
        """own with hit, the first node from n on of the node g that holds such a reading."""
        met = own.join(levels[level], ["circuit", "g"], "left")
        return met.withColumn("hit", F.get(F.filter("own", lambda x: (x["n"] >= F.col("n")) & result(x).isNotNull()), F.lit(0))).drop("own", "g")

    before = runs.select("circuit", "id", "baseline", (F.col("begin") - F.expr("interval 1 microsecond")).alias("__before"))
    places = kept(at.select("circuit", "id", F.col("ts").alias("at"), "pos"), "places")
    own = as_of(before, places, "circuit", "__before", "id", "at", "pos", "__pos").select("circuit", "id", "baseline", F.coalesce("__pos", F.lit(0)).cast("long").alias("n"))
    hits: list[DataFrame] = []
    for level in range(len(levels)):
        tried = kept(looked(own.withColumn("g", group), level), "tried")
        hits.append(tried.where("hit is not null").select("circuit", "id", "baseline", F.col("hit.n").alias("n")) if level else tried.where("hit is not null"))
        own = tried.where("hit is null").select("circuit", "id", "baseline", (F.floor(F.col("n") / fan) + 1).alias("n"))
    found = hits.pop()
    for level in reversed(range(len(levels) - 1)):
        down = looked(found.select("circuit", "id", "baseline", F.col("n").alias("g"), (F.col("n") * fan).alias("n")), level)
        found = (down.select("circuit", "id", "baseline", F.col("hit.n").alias("n")) if level else down.select(*hits[0].columns)).unionByName(hits[level])
        found = kept(found, "found")
    return found.select("id", F.struct("hit.t", "hit.pid", result(F.col("hit")).alias("r")).alias("beyond"))


def leak_test_history(commands: DataFrame, states: DataFrame, pressures: DataFrame, threshold: float = 3.0, rapid: float = 10.0) -> DataFrame:
    """(circuit, id, started_at, result, ended_at, baseline): every test that a run command asked for, by LEAK_RESULTS.

    commands: (circuit, id, ts, kind run or stop, minutes); states: (circuit, id, ts, role open_stop, closed_stop or fault, is_on); pressures: (circuit,
    id, ts, pressure, drop_5s). A run is refused at once with the valve not at its open stop (closed) or with a fault. Else pressure settles for a minute
    and the last reading is the baseline; without any the test goes on without one and can only time out. The first reading from then on that meets
    a condition ends it: rise over the threshold, rapid drop, drop over the threshold, time over; a stop ends it before. A run that comes while a test
    is on does nothing. A test that nothing ends has no result yet (null).

    Each run is followed to its end as if it had taken effect, all at once, by first_beyond(), so a long test does not meet each of its readings; those
    that did take effect are found by doubling the pointers to the next run after each end.
    """
    keep = ["circuit", "id", "ts", "kind", "minutes"]
    own = commands.where("circuit is not null and ts is not null").select(*keep).withColumn("t", seconds(F.col("ts")))
    runs, stops = own.where("kind = 'run'"), own.where("kind = 'stop'")
    for role in ("open_stop", "closed_stop", "fault"):
        now = states.where(F.col("role") == role).select("circuit", "id", F.col("ts").alias("at"), "is_on")
        runs = as_of(runs, now, "circuit", "ts", "id", "at", "is_on", role)
    pressures = kept(pressures.where("circuit is not null and ts is not null").select("circuit", "id", "ts", "pressure", "drop_5s"), "pressures")
    is_on = lambda c: F.coalesce(F.col(c), F.lit(False))
    refused = F.when(is_on("closed_stop") | ~is_on("open_stop"), LEAK_RESULTS["closed"]).when(is_on("fault"), LEAK_RESULTS["fault"])
    runs = runs.withColumns({"refused": refused, "begin": F.timestamp_micros(F.round((F.col("t") + SETTLE) * 1_000_000).cast("long")).cast(dict(commands.dtypes)["ts"])}).withColumn("over", F.col("t") + SETTLE + F.col("minutes") * 60)
    runs = kept(as_of(runs, pressures.select("circuit", "id", F.col("ts").alias("at"), "pressure"), "circuit", "begin", "id", "at", "pressure", "baseline"), "runs")
    places = pressures.select("circuit", "id", seconds(F.col("ts")).alias("t"))  # the readings
    due = first_from(runs, "over", places, "due")  # the reading that ends it by time
    stopped = first_from(runs, "t", stops, "stopped")
    runs = runs.join(due, "id", "left").join(stopped, "id", "left")
    # a test is read up to the reading after its time, but one that no reading ends is read to the last there is
    begin, at = F.col("begin_t"), lambda c: F.struct(f"{c}.t", f"{c}.pid")
    runs = runs.withColumn("begin_t", seconds(F.col("begin")))
    beyond = first_beyond(runs.where("refused is null"), pressures, threshold, rapid)
    ends = runs.where("refused is null").select("id", "begin_t", "due").join(beyond, "id", "left")
    ends = ends.withColumn("due", F.when(F.col("due.t") >= begin, F.struct(F.col("due.t").alias("t"), F.col("due.id").alias("pid"), F.lit(LEAK_RESULTS["passed"]).alias("r")))).withColumn("late", F.col("due").isNotNull() & (at("due") < at("beyond")))
    # without a reading in its time a test whose end was due before it began has no result
    ends = ends.join(runs.select("id", F.col("due.t").alias("until")), "id").where("until is null or until >= begin_t")
    found = ends.select("id", F.when(F.col("beyond").isNull() | F.col("late"), F.col("due")).otherwise(F.col("beyond")).alias("found"))
    runs = runs.join(found, "id", "left")
    by_stop = F.col("stopped").isNotNull() & (F.col("found").isNull() | (F.col("stopped.t") <= F.col("found.t")))
    runs = runs.withColumns({
        "result": F.coalesce("refused", F.when(by_stop, LEAK_RESULTS["stopped"]), F.col("found.r")),
        "ended": F.when(F.col("refused").isNotNull(), F.col("t")).when(by_stop, F.col("stopped.t")).otherwise(F.col("found.t")),
    })
    runs = kept(runs.withColumn("free", F.col("ended") + F.lit(1e-6)).select("circuit", "id", "t", "ts", F.lit("run").alias("kind"), "result", "ended", "free", F.when(F.col("refused").isNull(), F.col("baseline")).alias("baseline")), "runs")
    rows = kept(runs.join(first_from(runs, "free", runs, "next"), "id", "left"), "runs")
    stamp = F.timestamp_micros(F.round(F.col("ended") * 1_000_000).cast("long")).cast(dict(commands.dtypes)["ts"])
    return rows.join(took_effect(rows, ("run",)), "id", "left_semi").select("circuit", "id", F.col("ts").alias("started_at"), "result", stamp.alias("ended_at"), "baseline")


def travel_faults(commands: DataFrame, stops: DataFrame, seconds_allowed: int = TRAVEL) -> DataFrame:
    """(circuit, id, ts): when a valve command (kind open or close) has run for too long: its end stop did not come on, and no other command replaced it.

    stops: (circuit, id, ts, role open_stop or closed_stop, is_on). A stop that is on already ends the travel at once.
    """
    own = commands.where("circuit is not null and ts is not null").withColumn("t", seconds(F.col("ts")))
    out = None
    for kind, role in (("open", "open_stop"), ("close", "closed_stop")):
        side = own.where(F.col("kind") == kind).withColumn("after", F.col("t") + F.lit(1e-6))
        of_role = stops.where(F.col("role") == role)
        there = as_of(side, of_role.select("circuit", "id", F.col("ts").alias("at"), "is_on"), "circuit", "ts", "id", "at", "is_on", "there").select("id", "there")
        came = first_from(side, "t", of_role.where("is_on").select("circuit", "id", seconds(F.col("ts")).alias("t")), "came")
        other = first_from(side, "after", own, "other")
        late = side.join(there, "id", "left").join(came, "id", "left").join(other, "id", "left").withColumn("limit", F.col("t") + seconds_allowed)
        late = late.where(~F.coalesce("there", F.lit(False)) & (F.col("came").isNull() | (F.col("came.t") > F.col("limit"))) & (F.col("other").isNull() | (F.col("other.t") >= F.col("limit"))))
        part = late.select("circuit", "id", F.timestamp_micros(F.round(F.col("limit") * 1_000_000).cast("long")).cast(dict(commands.dtypes)["ts"]).alias("ts"))
        out = part if out is None else out.unionByName(part)
    return out


def fault_history(triggers: DataFrame, resets: DataFrame) -> DataFrame:
    """(circuit, id, ts, is_on, reason): after each trigger and reset, whether a fault is on, and the reason of the first trigger since the last reset.

    triggers: (circuit, id, ts, reason); resets: (circuit, id, ts). At one time a trigger comes before a reset. A fault stays until it is reset.
    """
    both = triggers.select("circuit", "id", "ts", "reason", F.lit(0).alias("__reset")).unionByName(resets.select("circuit", "id", "ts", F.lit(None).cast("string").alias("reason"), F.lit(1).alias("__reset")))
    numbered = kept(running(both.where("circuit is not null and ts is not null"), "circuit", ["ts", "__reset", "id"], {"__n": ("sum", F.col("__reset").cast("long"))}), "faults")
    first = numbered.where("__reset = 0").groupBy("circuit", "__n").agg(F.min_by("reason", F.struct("ts", "id")).alias("first"))
    out = numbered.join(first, ["circuit", "__n"], "left")
    on = F.col("__reset") == 0
    return out.select("circuit", "id", "ts", on.alias("is_on"), F.when(on, F.col("first")).alias("reason"))
