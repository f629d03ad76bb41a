"""Joins and lookups of the stored tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import running, seconds
from tidewatch.sources.history import kept


def named_events(events: DataFrame, clusters: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Events with their cluster and its fixture; the name shown is the user's, the suggested type, 'Cluster n' or a dash."""
    own = clusters.select("circuit", "cluster_id", F.col("fixture_id").alias("cluster_fixture"), "suggested_type")
    names = fixtures.select(F.col("fixture_id").alias("cluster_fixture"), "fixture_name", "confirmed")
    shown = F.coalesce("fixture_name", "suggested_type", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")), F.lit("—"))
    return events.join(own, ["circuit", "cluster_id"], "left").join(names, "cluster_fixture", "left").withColumn("display_name", shown)


def named_clusters(clusters: DataFrame, fixtures: DataFrame) -> DataFrame:
    return clusters.join(fixtures.select("fixture_id", "fixture_name", "fixture_type", "confirmed"), "fixture_id", "left")


def type_cache(clusters: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(circuit, cluster_id, fixture_type) of clusters whose fixture is confirmed and typed."""
    typed = fixtures.where("confirmed and fixture_type is not null").select("fixture_id", "fixture_type")
    return clusters.join(typed, "fixture_id").select("circuit", "cluster_id", "fixture_type")


def days_to_summarise(events: DataFrame, summaries: DataFrame) -> DataFrame:
    """(circuit, day) of events with no summary, or one that was computed before the day had ended."""
    days = events.select("circuit", F.to_date("start_ts").alias("day")).distinct()
    done = summaries.where(F.to_date("computed_at") > F.col("day")).select("circuit", "day")
    return days.join(done, ["circuit", "day"], "left_anti")


def missing_keys(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).dropna().distinct().join(stored.select(*keys), keys, "left_anti")


def previous_by_end(events: DataFrame, key: str = "circuit", within_seconds: float = 300.0) -> DataFrame:
    """Events with prev_cluster_id and seconds_since_prev_event: the event of the latest end before the start, if under within_seconds ago.

    Events may overlap, so the one before by start is not it. Ends and starts are one series; ends at a start's own instant do not count.
    """
    stamp = lambda c, src: events.select(F.col(key), F.col(c).alias("__ts"), F.lit(src).alias("__src"), "id", F.col("cluster_id").alias("__c"))
    ends = stamp("end_ts", 1).withColumn("__end", F.struct(F.col("__ts").alias("t"), F.col("__c").alias("c")))
    both = ends.unionByName(stamp("start_ts", 0).withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)))
    found = running(both, key, ["__ts", "__src", "id"], {"__last": ("last", F.col("__end"))}).where("__src = 0")
    gap = seconds(F.col("start_ts")) - seconds(F.col("__last.t"))
    near = (gap >= 0) & (gap < within_seconds)
    out = events.join(found.select(F.col("id"), "__last"), "id", "left")
    return out.withColumns({"seconds_since_prev_event": F.when(near, gap), "prev_cluster_id": F.when(near, F.col("__last.c"))}).drop("__last")


def latest_states(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "state", default: str | None = None, tie: str = "id") -> DataFrame:
    """The last value of each key, of one instant that of the largest tie; the default where it is null."""
    return readings.groupBy(*keys).agg(F.coalesce(F.max_by(value, F.struct(ts, tie)), F.lit(default)).alias(value), F.max(ts).alias(ts))


def pivot_latest(readings: DataFrame, key: str, role: str, roles: list[str], ts: str, value: str, tie: str = "id") -> DataFrame:
    """One row per key with the last value of each role, of one instant that of the largest tie. Roles are given, so no pass looks for them."""
    return readings.groupBy(key).agg(*[F.max_by(value, F.when(F.col(role) == r, F.struct(ts, tie))).alias(r) for r in roles])


def tiered_search(rows: DataFrame, text: str, names: list[str], vendor: Column) -> DataFrame:
    """The rows of the best tier that has any: a name equal to the text, holding it, the vendor's, all. Case does not count."""
    low = text.lower()
    exact, partly = F.lit(False), F.lit(False)
    for n in names:
        exact |= F.coalesce(F.lower(n) == low, F.lit(False))
        partly |= F.coalesce(F.contains(F.lower(n), F.lit(low)), F.lit(False))
    tiered = rows.withColumn("tier", F.when(exact, 1).when(partly, 2).when(vendor, 3).otherwise(4))
    best = tiered.agg(F.min("tier").alias("__best"))  # one row
    return tiered.join(F.broadcast(best), F.col("tier") == F.col("__best")).drop("__best")


def match_roles(entities: DataFrame, roles: dict[str, tuple[str, str]]) -> DataFrame:
    """(device_id, role, entity_id): per role the entity of its domain whose name, else whose id, matches its pattern; ties by id.

    The roles are a short fixed list, so each entity is read once and gets an array of the roles it matches.
    """
    hits = []
    for role, (domain, pattern) in roles.items():
        kind = F.when(F.regexp_like("name", F.lit("(?i)" + pattern)), 0).when(F.regexp_like("entity_id", F.lit("(?i)" + pattern)), 1)
        hits.append(F.when((F.col("domain") == domain) & kind.isNotNull(), F.struct(F.lit(role).alias("role"), kind.alias("how"))))
    found = entities.select("device_id", "entity_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.groupBy("device_id", F.col("h.role").alias("role")).agg(F.min_by("entity_id", F.struct("h.how", "entity_id")).alias("entity_id"))


def recent(events: DataFrame, limit: int = 100, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """The newest events first; the limit holds only without a date range. Ties by id."""
    own = events
    if date_from is not None:
        own = own.where(F.to_date("start_ts") >= date_from)
    if date_to is not None:
        own = own.where(F.to_date("start_ts") <= date_to)
    own = own.orderBy(F.desc("start_ts"), "id")
    return own if date_from is not None or date_to is not None else own.limit(limit)


def _distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two arrays, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_center(points: DataFrame, centers: DataFrame, vector: str, center: str, most: int = 4096) -> DataFrame:
    """points with center_id and distance of the nearest center (Euclid, ties to the smaller id); null for both without centers or a vector.

    Up to ``most`` centers, which are counted first, are broadcast as one array; more go by nearest_by_pivots().
    """
    if centers.limit(most + 1).count() > most:
        return nearest_by_pivots(points, centers, vector, center)
    packed = centers.agg(F.array_sort(F.collect_list(F.struct(F.col("center_id"), F.col(center).alias("c")))).alias("__all"))
    each = F.transform("__all", lambda x: F.struct(_distance(F.col(vector), x["c"]).alias("d"), x["center_id"].alias("i")))
    out = points.join(F.broadcast(packed)).withColumn("__best", F.array_min(F.filter(each, lambda x: x["d"].isNotNull())))
    return out.withColumns({"center_id": F.col("__best.i"), "distance": F.col("__best.d")}).drop("__all", "__best")


def _best_of_slices(block: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nearest center of each point of one slice of points and one of centers, ``block`` points at a time.

    A matrix product leaves the few centers that may be nearest; their distances are then summed exactly as _distance() does.
    """

    def vectors(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)

    def best(points: pa.Table, centers: pa.Table) -> pa.Table:
        if not points.num_rows or not centers.num_rows:
            return pa.table({"__row": pa.array([], "int64"), "center_id": pa.array([], "int64"), "__dist": pa.array([], "float64")})
        order = np.argsort(centers["center_id"].to_numpy())
        xs, cs, ids = vectors(points["__v"]), vectors(centers["c"])[order], centers["center_id"].to_numpy()[order]
        found, far = np.empty(len(xs), "int64"), np.empty(len(xs))
        with np.errstate(all="ignore"):
            squares = (cs * cs).sum(1)
            for at in range(0, len(xs), block):
                x = xs[at : at + block]
                own = (x * x).sum(1)[:, None]
                near = own + squares - 2 * (x @ cs.T)
                most = np.fmin.reduce(near, 1)[:, None] + 1e-12 * (own + squares.max())
                i, j = np.nonzero(~(near > most))  # what is no number stays in
                total = np.zeros(len(i))
                for k in range(xs.shape[1]):
                    gap = x[i, k] - cs[j, k]
                    total += gap * gap
                dist = np.sqrt(total)
                pick = np.lexsort((j, dist, i))
                first = pick[np.unique(i[pick], return_index=True)[1]]
                found[at : at + block], far[at : at + block] = ids[j[first]], dist[first]
        return pa.table({"__row": points["__row"], "center_id": found, "__dist": far})

    return best


def nearest_by_pivots(points: DataFrame, centers: DataFrame, vector: str, center: str, pivots: int = 64, block: int = 256, slice_rows: int = 16384) -> DataFrame:
    """nearest_center() for any number of centers: exact, and nothing that grows with them is broadcast.

    Some centers are pivots, and each center belongs to the nearest of them, with its distance to it. The distance to the nearest pivot bounds a
    point's nearest center from above; by the triangle inequality a pivot whose centers all lie farther is left out. The centers of a pivot, and the points
    that it remains for, are dealt into slices of some ``slice_rows``, each pair of them one group of bounded size, in which ``block`` points at a time
    meet the centers: a row is sent once for each slice of the other side, not for each pair. Where no pivot can be left out all distances are made.
    """
    own = kept(points.withColumn("__row", F.monotonically_increasing_id()), "points")
    stored = kept(centers.select("center_id", F.col(center).cast("array<double>").alias("c")).where("c is not null").groupBy("c").agg(F.min("center_id").alias("center_id")), "centers")  # of equal centers the smallest wins
    picked = kept(stored.orderBy(F.xxhash64("c"), "center_id").limit(pivots), "pivots")
    chosen = kept(picked.agg(F.collect_list("c").alias("__pivots")), "pivots")  # one row of so many centers
    to_pivots = lambda v: F.transform("__pivots", lambda p: _distance(v, p))
    placed = stored.join(F.broadcast(chosen)).withColumn("__d", to_pivots(F.col("c"))).withColumn("__r", F.array_min("__d"))
    placed = kept(placed.where("__r is not null").select("center_id", "c", "__r", F.array_position("__d", F.col("__r")).alias("__p")), "placed")
    slices = lambda n: F.ceil(n / slice_rows).cast("long")
    rings = kept(placed.groupBy("__p").agg(F.min("__r").alias("low"), F.max("__r").alias("high"), slices(F.count("*")).alias("blocks")), "rings")  # a row a pivot
    known = chosen.join(F.broadcast(rings.agg(F.array_sort(F.collect_list(F.struct("__p", "low", "high", "blocks"))).alias("__rings"))))
    met = own.join(F.broadcast(known)).withColumn("__d", to_pivots(F.col(vector))).withColumn("__most", F.array_min("__d") * (1 + 1e-12) + 1e-12)
    to = lambda r: F.element_at("__d", r["__p"].cast("int"))
    near = F.filter("__rings", lambda r: (to(r) - r["high"] <= F.col("__most")) & (r["low"] - to(r) <= F.col("__most")))
    met = kept(met.select("__row", F.transform(near, lambda r: F.struct(r["__p"].alias("__p"), r["blocks"].alias("blocks"))).alias("__near")), "met").select("__row", F.explode("__near").alias("__g")).select("__row", "__g.*")
    sides = rings.select("__p", "blocks").join(met.groupBy("__p").agg(slices(F.count("*")).alias("sides")), "__p")  # a row a pivot
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt_points = met.join(F.broadcast(sides.select("__p", "sides")), "__p").select("__row", "__p", F.pmod(F.xxhash64("__row"), F.col("sides")).alias("__s"), every("blocks").alias("__b"))
    dealt_points = own.select("__row", F.col(vector).alias("__v")).join(dealt_points, "__row")
    dealt_centers = placed.join(F.broadcast(sides), "__p").select("center_id", "c", "__p", F.pmod(F.xxhash64("center_id"), F.col("blocks")).alias("__b"), every("sides").alias("__s"))
    keys = ["__p", "__b", "__s"]
    best = dealt_points.groupBy(*keys).cogroup(dealt_centers.groupBy(*keys)).applyInArrow(_best_of_slices(block), "__row long, center_id long, __dist double")
    found = best.groupBy("__row").agg(F.min(F.struct(F.col("__dist").alias("d"), F.col("center_id").alias("i"))).alias("__best"))
    return own.join(found, "__row", "left").withColumns({"center_id": F.col("__best.i"), "distance": F.col("__best.d")}).drop("__row", "__best")


def quiet_rank(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
