"""Grouping events into fixtures: feature vectors, running scaling, nearest centers, a gate by fixture type, rules and an online learner."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import confidence_level, hour_circle
from tidewatch.operators.series import running

FEATURES = ["avg_flow_lpm", "duration_seconds", "volume_litres", "pressure_delta_psi", "has_pressure_transient", "flow_variability", "hour_sin", "hour_cos", "duration_log"]
THRESHOLD, FADING, SEQUENCE_GAP = 1.5, 0.05, 300.0
#: Distance allowed by fixture type, and the weights of features that differ from 1.
GATES = {
    "toilet": (0.6, {"volume_litres": 3, "duration_seconds": 3, "avg_flow_lpm": 2, "has_pressure_transient": 2, "hour_sin": 0, "hour_cos": 0}),
    "ice_maker": (0.5, {"volume_litres": 4, "duration_seconds": 4, "avg_flow_lpm": 3, "hour_sin": 0, "hour_cos": 0}),
    "refrigerator_water": (0.7, {"volume_litres": 2.5, "duration_seconds": 2, "avg_flow_lpm": 2, "hour_sin": 0, "hour_cos": 0}),
    "humidifier": (1.0, {"volume_litres": 2, "avg_flow_lpm": 2.5, "duration_seconds": 0, "hour_sin": 0, "hour_cos": 0}),
    "boiler_makeup": (1.0, {"volume_litres": 2.5, "avg_flow_lpm": 2, "hour_sin": 0, "hour_cos": 0}),
    "shower": (2.5, {"avg_flow_lpm": 3, "pressure_delta_psi": 2, "flow_variability": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "bath": (2.8, {"avg_flow_lpm": 3, "pressure_delta_psi": 2, "duration_seconds": 0, "volume_litres": 0}),
    "bathroom_tap": (1.8, {"avg_flow_lpm": 2.5, "pressure_delta_psi": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "kitchen_tap": (1.8, {"avg_flow_lpm": 2.5, "pressure_delta_psi": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "utility_tap": (2.0, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "bidet": (1.6, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "ro_drinking_faucet": (1.5, {"avg_flow_lpm": 2.5, "duration_seconds": 0, "volume_litres": 0}),
    "washing_machine": (3.0, {"avg_flow_lpm": 2, "pressure_delta_psi": 1.5, "flow_variability": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "dishwasher": (2.8, {"avg_flow_lpm": 2, "flow_variability": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "water_softener": (2.5, {"avg_flow_lpm": 2, "flow_variability": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "irrigation_zone": (2.2, {"avg_flow_lpm": 2.5, "pressure_delta_psi": 1.5, "duration_seconds": 0, "volume_litres": 0}),
    "pool_fill": (1.8, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "hose_bib": (2.5, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "outdoor_tap": (2.5, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "evaporative_cooler": (1.8, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "ro_system_whole_house": (2.0, {"avg_flow_lpm": 2, "duration_seconds": 0, "volume_litres": 0}),
    "leak_test": (0.8, {"volume_litres": 3, "duration_seconds": 3, "avg_flow_lpm": 2}),
    "other": (1.5, {}),
}
#: Rules in order, the first that holds names the type: (type, confidence, ranges of volume, duration, flow, transient).
RULES = [
    ("water_softener", 0.70, (100, 400), (1800, 5400), (3, 8), None),
    ("bath", 0.80, (80, 250), (180, 600), (12, 25), None),
    ("shower", 0.85, (20, 100), (240, 1200), (5, 15), None),
    ("washing_machine", 0.75, (15, 80), (60, 300), (8, 18), None),
    ("dishwasher", 0.75, (8, 15), (60, 180), (4, 8), None),
    ("humidifier", 0.55, (0.5, 3), (30, 180), (0.3, 1.5), None),
    ("toilet", 0.90, (4, 9), (20, 60), (4, 25), 0.5),
    ("bathroom_tap", 0.65, (0.3, 3), (5, 30), None, None),
    ("kitchen_tap", 0.60, (0.5, 8), (5, 60), None, None),
    ("ice_maker", 0.65, (0.05, 0.4), (3, 15), None, None),
]


def feature_columns(events: DataFrame) -> DataFrame:
    """events with the FEATURES that are derived, and features_missing (no flow, or no duration)."""
    sin, cos = hour_circle(F.hour("start_ts"))
    out = events.withColumns({"hour_sin": sin, "hour_cos": cos, "duration_log": F.log1p("duration_seconds")})
    return out.withColumn("features_missing", F.col("avg_flow_lpm").isNull() | F.coalesce(F.col("duration_seconds") <= 0, F.lit(True)))


def standardised(events: DataFrame, key: str, order: list[str], names: list[str]) -> DataFrame:
    """events with z_<name>: each feature less the running mean over the running deviation (population), both with this row; 0 where that is 0."""
    sums = {"__n": ("sum", F.lit(1.0))}
    for c in names:
        sums |= {f"__s_{c}": ("sum", F.col(c).cast("double")), f"__q_{c}": ("sum", F.col(c).cast("double") * F.col(c))}
    own = running(events, key, order, sums)
    put = {}
    for c in names:
        mean = F.col(f"__s_{c}") / F.col("__n")
        var = F.greatest(F.col(f"__q_{c}") / F.col("__n") - mean * mean, F.lit(0.0))
        put[f"z_{c}"] = F.when(var > 1e-9, (F.col(c) - mean) / F.sqrt(var)).otherwise(0.0)
    return own.withColumns(put).drop(*sums)


def running_centroids(events: DataFrame, order: list[str], names: list[str]) -> DataFrame:
    """Matched events with member_count, level, mean_<name> of their cluster so far, and suggest (the first and every tenth member)."""
    own = events.where("cluster_id is not null").withColumn("__ck", F.struct("circuit", "cluster_id"))
    sums = {"member_count": ("sum", F.lit(1).cast("long"))} | {f"mean_{c}": ("sum", F.col(c).cast("double")) for c in names}
    own = running(own, "__ck", order, sums).withColumns({f"mean_{c}": F.col(f"mean_{c}") / F.col("member_count") for c in names})
    n = F.col("member_count")
    return own.withColumns({"level": confidence_level(n), "suggest": (n == 1) | (n % 10 == 0)}).drop("__ck")


def gate(rows: DataFrame, type_col: str, vector: dict[str, Column], center: dict[str, Column]) -> DataFrame:
    """rows with gate_distance and accepted: the weighted distance to the center is at most that of the fixture type; no type, no gate."""
    def weighted(weights: dict[str, float]) -> Column:
        return F.sqrt(sum(((vector[f] - center[f]) * (vector[f] - center[f]) * float(weights.get(f, 1.0)) for f in vector), F.lit(0.0)))

    kind, distance, limit = F.col(type_col), weighted(GATES["other"][1]), F.lit(GATES["other"][0])
    for name, (most, weights) in GATES.items():
        distance, limit = F.when(kind == name, weighted(weights)).otherwise(distance), F.when(kind == name, most).otherwise(limit)
    out = rows.withColumn("gate_distance", F.when(kind.isNotNull(), distance))
    return out.withColumn("accepted", F.coalesce(F.col("gate_distance") <= limit, F.lit(True)))


def remapped(learned: DataFrame, stored: DataFrame, names: list[str], type_col: str = "suggested_type", default: float = 3.0) -> DataFrame:
    """(circuit, learned_id, cluster_id, distance): each learned group's nearest stored cluster of its circuit, null where none is near enough.

    learned(circuit, learned_id, names) and stored(circuit, cluster_id, type, names) hold one row a group; a stored cluster takes a group
    within the distance that its type allows, else default. Two that are near enough lie no farther apart in the first feature than the
    largest such distance, so only groups of neighbouring strips of it are compared.
    """
    width = max([default, *(d for d, _ in GATES.values())])
    strip = lambda c: F.floor(F.col(c) / width)
    around = F.explode(F.array(*[strip(names[0]) + i for i in (-1, 0, 1)]))
    theirs = stored.select("circuit", "cluster_id", F.col(type_col).alias("kind"), around.alias("__strip"), *[F.col(n).alias(f"s_{n}") for n in names])
    limit = F.lit(default)
    for kind, (distance, _) in GATES.items():
        limit = F.when(F.col("kind") == kind, distance).otherwise(limit)
    gap = F.sqrt(sum(((F.col(n) - F.col(f"s_{n}")) * (F.col(n) - F.col(f"s_{n}")) for n in names), F.lit(0.0)))
    pairs = learned.withColumn("__strip", strip(names[0])).join(theirs, ["circuit", "__strip"]).select("circuit", "learned_id", "cluster_id", gap.alias("distance"), limit.alias("limit")).where("distance <= limit")
    near = pairs.groupBy("circuit", "learned_id").agg(F.min(F.struct("distance", "cluster_id")).alias("x"))
    return learned.select("circuit", "learned_id").join(near, ["circuit", "learned_id"], "left").select("circuit", "learned_id", "x.cluster_id", "x.distance")


def match_confidence(distance: Column, scale: float = THRESHOLD) -> Column:
    return F.exp(-distance / scale)


def classified(rows: DataFrame) -> DataFrame:
    """rows with suggested_type and suggested_confidence from the rules, missing values read as 0; (null, 0) if none holds."""
    v, d, f, t = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("volume_litres", "duration_seconds", "avg_flow_lpm", "has_pressure_transient"))
    irrigation = F.col("circuit_type").isin("irrigation", "zone")
    zone, hose = irrigation & (d >= 300) & (f >= 5), irrigation & d.between(30, 300) & (f >= 3)
    kind, sure = F.when(zone, "irrigation_zone").when(hose, "hose_bib"), F.when(zone, 0.85).when(hose, 0.55)
    for name, chance, vs, ds, fs, ts in RULES:
        holds = ~irrigation & v.between(*vs) & d.between(*ds)
        holds = holds & f.between(*fs) if fs else holds
        holds = holds & (t > ts) if ts is not None else holds
        kind, sure = kind.when(holds, name), sure.when(holds, chance)
    return rows.withColumns({"suggested_type": kind, "suggested_confidence": sure.otherwise(0.0)})


class MicroClusters:
    """An online density-based learner: weighted micro-clusters that fade, and shared density between those that overlap.

    There are few micro-clusters at a time, in lists by their ids: a row costs few calls of small vectors, and powers of the fading are looked up by age.
    """

    def __init__(self, radius: float = THRESHOLD, fading: float = FADING, every: int = 2, overlap: float = 0.3, least: float = 1.0) -> None:
        self.radius, self.fading, self.every, self.overlap, self.least = radius, fading, every, overlap, least
        self.t, self.next_id = 0, 0
        self.ids: list[int] = []
        self.centers: list[np.ndarray] = []
        self.weights: list[tuple[float, int]] = []
        self.shared: dict[tuple[int, int], tuple[float, int]] = {}
        self.powers: list[float] = []

    def _faded(self, at: tuple[float, int]) -> float:
        age = self.t - at[1]
        while age >= len(self.powers):
            self.powers.append(2 ** (-self.fading * len(self.powers)))
        return at[0] * self.powers[age]

    def learn(self, x: np.ndarray) -> None:
        self.t += 1
        radius, near = self.radius, []
        for k, center in enumerate(self.centers):
            gap = center - x
            d = sqrt(gap.dot(gap))
            if d <= radius:
                near.append((k, d))
        if not near:
            self.ids.append(self.next_id)
            self.centers.append(x.copy())
            self.weights.append((1.0, self.t))
            self.next_id += 1
        else:
            before = [self.centers[k] for k, _ in near]
            for (k, d), old in zip(near, before, strict=True):
                self.weights[k] = self._faded(self.weights[k]) + 1, self.t
                self.centers[k] = old + np.exp(-(d * d) / (2 * (radius / 3) ** 2)) * (x - old)
            stays = [False] * len(near)
            for a in range(len(near)):
                for b in range(a + 1, len(near)):
                    i, j = near[a][0], near[b][0]
                    pair = self.ids[i], self.ids[j]
                    self.shared[pair] = self._faded(self.shared.get(pair, (0.0, self.t))) + 1, self.t
                    if stays[a] and stays[b]:
                        continue  # both are where they were
                    gap = self.centers[i] - self.centers[j]
                    if sqrt(gap.dot(gap)) < radius:
                        self.centers[i], self.centers[j], stays[a], stays[b] = before[a], before[b], True, True
        if self.t % self.every == 0:
            self._clean()

    def _clean(self) -> None:
        weak = 2 ** (-self.fading * self.every)
        keep = [k for k, w in enumerate(self.weights) if not self._faded(w) < weak]
        if len(keep) < len(self.ids):
            gone = set(self.ids) - {self.ids[k] for k in keep}
            self.ids, self.centers, self.weights = [self.ids[k] for k in keep], [self.centers[k] for k in keep], [self.weights[k] for k in keep]
            self.shared = {p: s for p, s in self.shared.items() if p[0] not in gone and p[1] not in gone}
        if self.shared:
            self.shared = {p: s for p, s in self.shared.items() if self._faded(s) >= weak * self.overlap}

    def _groups(self) -> list[tuple[int, list[int], np.ndarray]]:
        """(group, its members, its weighted center) of the micro-clusters that are heavy enough; the group is its smallest member."""
        own = {}
        for i, center, weight in zip(self.ids, self.centers, self.weights, strict=True):
            w = self._faded(weight)
            if w >= self.least * 0.5:
                own[i] = w, center
        if not self.shared:
            return [(i, [i], center * w / w) for i, (w, center) in own.items()]
        root = {i: i for i in own}

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for (a, b), s in self.shared.items():
            if a in own and b in own and self._faded(s) / ((own[a][0] + own[b][0]) / 2) >= self.overlap:
                low, high = sorted((find(a), find(b)))
                root[high] = low
        members: dict[int, list[int]] = {}
        for i in own:
            members.setdefault(find(i), []).append(i)
        out = []
        for g, ids in members.items():
            w = np.array([own[i][0] for i in ids])
            out.append((g, ids, (np.stack([own[i][1] for i in ids]) * w[:, None]).sum(0) / w.sum()))
        return out

    def groups(self) -> dict[int, tuple[int, np.ndarray]]:
        """(group, weighted center of the group) of each micro-cluster that is heavy enough."""
        return {i: (g, center) for g, ids, center in self._groups() for i in ids}

    def nearest(self, x: np.ndarray) -> tuple[int, float] | None:
        found = None
        for g, _, center in self._groups():
            gap = center - x
            at = sqrt(gap.dot(gap)), g
            if found is None or at < found:
                found = at
        return None if found is None else (found[1], found[0])


def learn_clusters(events: DataFrame, names: list[str], radius: float = THRESHOLD, fading: float = FADING) -> DataFrame:
    """(circuit, id, learned_id, distance): each event, in order of end, learned and then matched to the nearest group of its circuit.

    The learner's state depends on the order of a circuit's events, so one circuit is one sequential job: it runs as a stream of Arrow batches over
    sorted partitions and holds only the micro-clusters, never the rows of a circuit. Rows with a missing feature are not learned and get null.
    """
    own = events.select("circuit", "id", "end_ts", *[F.col(n).cast("double").alias(n) for n in names])
    dealt = own.repartition("circuit").sortWithinPartitions("circuit", "end_ts", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        circuit, learner = object(), None
        for batch in batches:
            ids, distances = [], []
            values = batch[names].to_numpy(float)
            complete = np.isfinite(values).all(axis=1)
            for c, x, whole in zip(batch["circuit"], values, complete.tolist(), strict=True):
                if c != circuit:
                    circuit, learner = c, MicroClusters(radius, fading)
                found = None
                if whole:
                    learner.learn(x)
                    found = learner.nearest(x)
                ids.append(found[0] if found else None)
                distances.append(found[1] if found else None)
            yield pd.DataFrame({"circuit": batch["circuit"], "id": batch["id"], "learned_id": pd.array(ids, "Int64"), "distance": pd.array(distances, "Float64")})

    return dealt.mapInPandas(run, "circuit string, id long, learned_id long, distance double")
