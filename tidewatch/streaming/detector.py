"""The live detector: usage events from flow, pressure and onset readings, one state machine per circuit, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "circuit string, start_ts timestamp, end_ts timestamp, start_trigger string, has_pressure_transient boolean, is_composite boolean, pre_event_pressure_psi double, min_pressure_psi double, avg_flow_lpm double, peak_flow_lpm double, n_flow long, propagation_delay_seconds double"
LOOKBACK, WINDOW, BUFFER = 120, 80, 400


@dataclass
class Circuit:
    """What a circuit remembers between readings; its size is bounded by the buffer."""

    threshold: float = 2.0
    min_seconds: float = 3.0
    sustain: float = 2.0
    flow: float = 0.0
    flow_since: float | None = None
    onset: bool = False
    buffer: list = field(default_factory=list)
    start: float | None = None
    trigger: str = ""
    transient: bool = False
    composite: bool = False
    baseline: float = 0.0
    lowest: float | None = None
    recent: list = field(default_factory=list)
    flow_sum: float = 0.0
    flow_peak: float = 0.0
    n_flow: int = 0
    delay: float | None = None

    def _begin(self, at: float, trigger: str) -> None:
        early = self.buffer[-LOOKBACK - WINDOW : -LOOKBACK] if len(self.buffer) >= LOOKBACK + WINDOW else self.buffer
        self.start, self.trigger, self.transient = at, trigger, trigger == "pressure"
        self.baseline = sum(early) / len(early) if early else 0.0
        self.composite, self.lowest, self.recent, self.delay = False, None, [], None
        self.flow_sum = self.flow_peak = 0.0
        self.n_flow = 0

    def _end(self, at: float) -> dict | None:
        began, self.start, self.flow_since = self.start, None, None
        if began is None or at - began < self.min_seconds:
            return None
        mean = self.flow_sum / self.n_flow if self.n_flow else 0.0
        return {"start": began, "end": at, "start_trigger": self.trigger, "has_pressure_transient": self.transient, "is_composite": self.composite, "pre_event_pressure_psi": self.baseline, "min_pressure_psi": self.lowest, "avg_flow_lpm": mean, "peak_flow_lpm": self.flow_peak, "n_flow": self.n_flow, "propagation_delay_seconds": self.delay}

    def read(self, at: float, role: str, state: str | None) -> dict | None:
        """Takes one reading; returns the event that it ends, if any."""
        if role == "reset":
            self.start = self.flow_since = None
            self.buffer = []
        elif role == "flow":
            try:
                value = float(state)
            except (TypeError, ValueError):
                value = 0.0
            self.flow = value = value if isfinite(value) and 0.01 <= value <= 200 else 0.0
            self.flow_since = (at if self.flow_since is None else self.flow_since) if value >= 0.05 else None
            if self.start is None and self.flow_since is not None and at - self.flow_since >= self.sustain:
                self._begin(self.flow_since, "flow")
            if self.start is not None:
                self.flow_sum, self.flow_peak, self.n_flow = self.flow_sum + value, max(self.flow_peak, value), self.n_flow + 1
                if value < 0.05 and not self.onset:
                    return self._end(at)
        elif role == "pressure":
            return self._pressure(at, state)
        elif role == "onset":
            on = state == "on"
            if on and not self.onset and self.start is not None and self.delay is None:
                self.delay = at - self.start
            if on and self.start is None:
                self._begin(at, "onset")
            self.onset = on
            if not on and self.start is not None and self.flow < 0.05:
                return self._end(at)
        return None

    def _pressure(self, at: float, state: str | None) -> None:
        try:
            value = float(state)
        except (TypeError, ValueError):
            self.buffer = []
            return
        if not isfinite(value) or not 0 <= value <= 500:
            return
        self.buffer = [*self.buffer[-BUFFER + 1 :], value]
        if len(self.buffer) >= LOOKBACK + WINDOW:
            early = self.buffer[-LOOKBACK - WINDOW : -LOOKBACK]
            if sum(early) / WINDOW - value >= self.threshold:
                if self.start is None:
                    self._begin(at, "pressure")
                elif not self.transient:
                    self.transient, self.trigger = True, f"pressure+{self.trigger}"
        if self.start is not None:
            self.recent = [*self.recent[-7:], value]
            self.lowest = value if self.lowest is None else min(self.lowest, value)
            if len(self.recent) == 8 and sum(self.recent[:5]) / 5 - value >= 1.5 * self.threshold:
                self.composite = True


NAMES = [c.split()[0] for c in EVENT.split(", ")]


def _frame(events: list[tuple[str, dict]]) -> pd.DataFrame:
    at = lambda t: pd.Timestamp(round(t * 1_000_000), unit="us")
    rows = [{"circuit": circuit, "start_ts": at(e.pop("start")), "end_ts": at(e.pop("end")), **e} for circuit, e in events]
    return pd.DataFrame(rows, columns=NAMES)


def detect(readings: DataFrame, threshold: float = 2.0, min_seconds: float = 3.0) -> DataFrame:
    """The events of readings (circuit, ts, id, role, state), read in order of (ts, role, id).

    A circuit's machine is sequential, but holds a bounded state only: its readings pass as batches of a sorted partition, never all at once.
    """
    own = readings.selectExpr("circuit", "cast(cast(ts as timestamp) as double) as at", "role", "state", "id")
    dealt = own.repartition("circuit").sortWithinPartitions("circuit", "at", "role", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, machine = None, None
        for batch in batches:
            out = []
            for circuit, at, role, state in zip(batch["circuit"], batch["at"], batch["role"], batch["state"], strict=True):
                if machine is None or circuit != name:
                    name, machine = circuit, Circuit(threshold, min_seconds)
                found = machine.read(at, role, state)
                if found:
                    out.append((name, found))
            if out:
                yield _frame(out)

    return dealt.mapInPandas(run, EVENT)


def detect_stream(readings: DataFrame, threshold: float = 2.0, min_seconds: float = 3.0) -> DataFrame:
    """The same on a stream: rows of a batch are sorted before they are read, later batches are taken to be later."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Circuit(threshold, min_seconds)
        if state.exists:
            packed = dict(zip(STATE_NAMES, state.get, strict=True))
            machine = Circuit(**{k: list(v) if k in ("buffer", "recent") else v for k, v in packed.items()})
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "role", "id"], kind="stable")
        found = [e for e in (machine.read(a, r, s) for a, r, s in zip(rows["at"], rows["role"], rows["state"], strict=True)) if e]
        state.update(tuple(asdict(machine)[k] for k in STATE_NAMES))
        yield _frame([(key[0], e) for e in found])

    own = readings.selectExpr("circuit", "cast(cast(ts as timestamp) as double) as at", "role", "state", "id")
    return own.groupBy("circuit").applyInPandasWithState(step, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


STATE = "threshold double, min_seconds double, sustain double, flow double, flow_since double, onset boolean, buffer array<double>, start double, trigger string, transient boolean, composite boolean, baseline double, lowest double, recent array<double>, flow_sum double, flow_peak double, n_flow long, delay double"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
