"""The live state of circuits: the last value of each of ten roles, as a batch and as a stream with a map of roles as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import scalars

#: The roles of a circuit, in the order of their columns.
ROLES = ["valve", "pressure_avg", "pressure_history", "flow", "fault", "fault_reason", "trickle", "leak_test", "leak_test_result", "volume"]
#: Seconds after which what a role said no longer counts, by its circuit's own newest reading; roles without an entry keep their last word.
TTL = {"pressure_avg": 600, "pressure_history": 600, "flow": 600}
UNKNOWN = ("unknown", "unavailable", "")


def latest_roles(readings: DataFrame, ttl: dict[str, int] | None = None) -> DataFrame:
    """(circuit, ts, one column per role): the newest time of each circuit and the last state of each role, null where there is none or it is too old.

    readings: (circuit, id, ts, role, state); of one time the larger id counts, a null state says nothing. Other roles only count for the newest time.
    """
    ttl = TTL if ttl is None else ttl
    place = lambda r: F.when((F.col("role") == r) & F.col("state").isNotNull(), F.struct("ts", "id"))
    own = readings.where("circuit is not null and ts is not null").groupBy("circuit").agg(F.max("ts").alias("newest"), *[F.max_by("state", place(r)).alias(r) for r in ROLES], *[F.max(place(r))["ts"].alias(f"__{r}") for r in ROLES])
    age = lambda r: F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col(f"__{r}").cast("timestamp"))
    fresh = [F.when(age(r) <= ttl[r] * 1_000_000, F.col(r)).alias(r) if r in ttl else F.col(r) for r in ROLES]
    return own.select("circuit", F.col("newest").alias("ts"), *fresh)


def shown(states: DataFrame) -> DataFrame:
    """What a panel shows of each circuit: the valve, pressure by the better of two sensors, flow, alarms, the leak test and the meter.

    Pressure comes from the history sensor if it says something, else from the averaged one. A reason is given with an active fault only. Text that is no
    number shows as null, a flow without one as 0.
    """
    known = lambda c: F.when(~F.coalesce(c, F.lit("")).isin(*UNKNOWN), c)
    on = lambda r: F.coalesce(F.col(r) == "on", F.lit(False))
    return states.select(
        "circuit", F.coalesce("valve", F.lit("unknown")).alias("valve_state"), scalars.number(F.coalesce(known(F.col("pressure_history")), F.col("pressure_avg"))).alias("pressure"), scalars.number(F.col("flow"), 0.0).alias("flow_rate"),
        on("fault").alias("fault_active"), F.when(on("fault"), F.coalesce(known(F.col("fault_reason")), F.lit(""))).otherwise("").alias("fault_reason"), on("trickle").alias("trickle_active"), on("leak_test").alias("leak_test_active"),
        F.coalesce("leak_test_result", F.lit("No test run")).alias("leak_test_result"), scalars.number(F.col("volume")).alias("volume_total"),
    )


class RoleStates(StatefulProcessor):
    """Keeps role -> (state, time, id) of a circuit; a batch of its readings gives one row of latest_roles() as it then stands."""

    def __init__(self, ttl: dict[str, int], keep_ms: int | None) -> None:
        self.ttl, self.keep_ms = ttl, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = T.StructType([T.StructField("state", T.StringType()), T.StructField("at", T.LongType()), T.StructField("id", T.LongType())])
        self.roles = handle.getMapState("roles", T.StructType([T.StructField("role", T.StringType())]), value, self.keep_ms)
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("at", T.LongType())]), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        newest = self.newest.get()[0] if self.newest.exists() else None
        last: dict = {}
        for part in rows:
            newest = max([int(part["at"].max()), *([] if newest is None else [newest])])
            for role, state, at, row_id in zip(part["role"], part["state"], part["at"], part["id"], strict=True):
                if role in ROLES and state is not None and (role not in last or (at, row_id) > last[role][1:]):
                    last[role] = (state, int(at), int(row_id))
        for role, new in last.items():
            old = self.roles.getValue((role,)) if self.roles.containsKey((role,)) else None
            if old is None or new[1:] > tuple(old[1:]):
                self.roles.updateValue((role,), new)
        self.newest.update((newest,))
        row = {"circuit": [key[0]], "at": [newest]}
        for role in ROLES:
            kept = self.roles.getValue((role,)) if self.roles.containsKey((role,)) else None
            row[role] = [None if kept is None or role in self.ttl and newest - kept[1] > self.ttl[role] * 1_000_000 else kept[0]]
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def role_stream(readings: DataFrame, ttl: dict[str, int] | None = None, keep_ms: int | None = None) -> DataFrame:
    """latest_roles() of a stream: a row for each circuit of a micro-batch, as it stands after it. Needs the RocksDB state store.

    Rows may come late or out of order; what is older than what a role said last changes nothing. With keep_ms, a circuit's state is dropped so long
    (in milliseconds of processing time) after its last change.
    """
    own = readings.where("circuit is not null and ts is not null").select("circuit", "role", "state", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "id")
    out = "circuit string, at long, " + ", ".join(f"{r} string" for r in ROLES)
    found = own.groupBy("circuit").transformWithStateInPandas(RoleStates(TTL if ttl is None else ttl, keep_ms), out, "Update", "None")
    return found.select("circuit", F.timestamp_micros("at").alias("ts"), *ROLES)
