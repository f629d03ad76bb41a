"""Write semantics on tables: upserts, merges, retention and de-duplication, as DataFrames of the new contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.intervals import in_interval


def replace_rows(stored: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert or replace: of all rows of a key the one of the largest seq stays, incoming before stored.

    An aggregate with map-side combine, so a key with many versions is reduced before it is shuffled.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    whole = F.struct(*stored.columns)
    return both.groupBy(*keys).agg(F.max_by(whole, F.struct("__new", seq)).alias("row")).select("row.*")


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Merge that keeps what is stored: incoming rows of new keys are added, one per key (the smallest)."""
    fresh = incoming.join(stored.select(*keys), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*incoming.columns)).alias("row")).select("row.*")
    return stored.unionByName(one)


def add_volumes(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Additive upsert: values of a key are summed."""
    return stored.select(*keys, value).unionByName(incoming.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def update_fields(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Update, else insert: non-null fields of changes win; keys are unique in both."""
    fields = [c for c in stored.columns if c not in keys]
    theirs = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields if c in changes.columns])
    joined = stored.join(theirs, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields])


def transitions(pairs: DataFrame) -> DataFrame:
    """Edges (circuit, from_cluster, to_cluster) with count, mean gap and last time: what a running mean upsert ends with."""
    return pairs.groupBy("circuit", "from_cluster", "to_cluster").agg(F.count("*").alias("count"), F.avg("gap_seconds").alias("mean_gap"), F.max("seen_at").alias("last_seen"))


def retained(rows: DataFrame, cutoff: Column, windows: DataFrame, ts: str = "start_ts") -> DataFrame:
    """Rows from the cutoff on, and older ones within a training window of their circuit (both ends included)."""
    old = rows.where(F.col(ts) < cutoff)
    return rows.where(F.col(ts) >= cutoff).unionByName(in_interval(old, windows, "circuit", ts, "started_at", "ends_at"))


def dedup_events(events: DataFrame, keys: list[str], rank: str, newest: bool = True, clear: list[str] | None = None) -> DataFrame:
    """One row per key, the newest (or oldest) by rank; where there were several, the columns in clear become null."""
    pick = F.max_by if newest else F.min_by
    own = events.groupBy(*keys).agg(pick(F.struct(*events.columns), F.col(rank)).alias("row"), F.count("*").alias("__n"))
    put = [F.when(F.col("__n") == 1, F.col("row")[c]).alias(c) if c in (clear or []) else F.col("row")[c].alias(c) for c in events.columns]
    return own.select(*put)


def normal_timestamp(text: Column) -> Column:
    """A text timestamp as UTC ISO text; no offset means UTC, Z is known, a text that is no time stays."""
    ts = F.try_to_timestamp(F.trim(text))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), text)


def seed_defaults(circuits: DataFrame, alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """stored with the default alerts of each circuit that it lacks; alerts for zones go to circuits of that type only.

    alerts is a short list: it is checked to be one before it is joined to every circuit.
    """
    if alerts.limit(1001).count() > 1000:
        raise ValueError("more than 1000 kinds of alert")
    kinds = alerts.agg(F.collect_list(F.struct("alert_type", "zone_only", "enabled")).alias("a"))
    all_rows = circuits.join(F.broadcast(kinds)).select("circuit", "circuit_type", F.explode("a").alias("a")).where("not a.zone_only or circuit_type = 'zone'")
    return insert_missing(stored, all_rows.select("circuit", "a.alert_type", "a.enabled"), ["circuit", "alert_type"])


def forget_clusters(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events with a null cluster where theirs was deleted."""
    lost = gone.select("circuit", "cluster_id").distinct().withColumn("__gone", F.lit(True))
    out = events.join(lost, ["circuit", "cluster_id"], "left")
    return out.withColumn("cluster_id", F.when(F.col("__gone").isNull(), F.col("cluster_id"))).drop("__gone")


def known_columns(rows: DataFrame, target: list[str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c in set(target)])
