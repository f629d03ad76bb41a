"""Daily, hourly and per-group summaries of usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = F.to_date


def daily_summary(events: DataFrame, score_alert: float = 0.6) -> DataFrame:
    """One row per circuit and day that has events; sums and counts of nothing are 0, averages of nothing null."""
    return events.groupBy("circuit", F.to_date("start_ts").alias("day")).agg(
        F.count("*").alias("event_count"),
        F.coalesce(F.sum("volume_litres"), F.lit(0.0)).alias("total_volume"),
        F.avg("avg_flow_lpm").alias("avg_flow"),
        F.max("peak_flow_lpm").alias("peak_flow"),
        F.avg("pre_event_pressure_psi").alias("avg_pressure"),
        F.min("min_pressure_psi").alias("min_pressure"),
        F.count_if(F.col("anomaly_score") > score_alert).alias("anomaly_count"),
        F.count_if(F.col("triggered_alert")).alias("alert_count"),
    )


def top_per_group(events: DataFrame, group: list[str | Column], item: str, n: int, name: str = "breakdown") -> DataFrame:
    """Per group: the n most frequent items as JSON [{"fixture_id", "count"}], and the first with its count; ties go to the smaller item.

    Counted before it is ranked, so a window holds one row per item of a group. Null items do not count; a group of only nulls is left out.
    """
    keys = [g if isinstance(g, str) else None for g in group]
    counts = events.where(F.col(item).isNotNull()).groupBy(*group, item).agg(F.count("*").alias("__n"))
    names = [k or c for k, c in zip(keys, counts.columns, strict=False)]
    order = Window.partitionBy(*names).orderBy(F.desc("__n"), item)
    ranked = counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__r", item, "__n")))
    as_json = F.to_json(F.transform(listed, lambda x: F.struct(x[item].alias("fixture_id"), x["__n"].alias("count"))))
    return ranked.groupBy(*names).agg(as_json.alias(name), F.min_by(item, "__r").alias(f"top_{item}"), F.max("__n").alias("top_count"))


def daily_report(events: DataFrame, n: int = 5) -> DataFrame:
    """The daily summary with the n busiest fixtures of the day."""
    own = events.withColumn("day", F.to_date("start_ts"))
    return daily_summary(events).join(top_per_group(own, ["circuit", "day"], "fixture_id", n), ["circuit", "day"], "left")


def fixture_days(events: DataFrame) -> DataFrame:
    own = events.where("fixture_id is not null").groupBy("circuit", "fixture_id", F.to_date("start_ts").alias("day"))
    return own.agg(F.count("*").alias("event_count"), F.sum("volume_litres").alias("total_volume"), F.avg("duration_seconds").alias("avg_duration"), F.avg("avg_flow_lpm").alias("avg_flow"))


def volume_since(events: DataFrame, circuits: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(circuit, volume) from midnight ``days`` days before as_of's day up to as_of; 0 for a circuit without events."""
    first = F.date_sub(F.to_date(as_of), days)
    own = events.where((F.to_date("start_ts") >= first) & (F.col("start_ts") <= as_of)).groupBy("circuit").agg(F.sum("volume_litres").alias("v"))
    return circuits.join(own, "circuit", "left").select("circuit", F.round(F.coalesce("v", F.lit(0.0)), 1).alias("volume"))


def hourly_volume(events: DataFrame) -> DataFrame:
    """Volume by the hour in which an event starts: an additive roll-up."""
    return events.groupBy("circuit", F.date_trunc("hour", "start_ts").cast(dict(events.dtypes)["start_ts"]).alias("hour_ts")).agg(F.sum("volume_litres").alias("volume"))


def calendar_rollup(daily: DataFrame) -> DataFrame:
    """Volume per circuit by year, month and day with the totals of every level, that of all circuits too (null below it)."""
    own = daily.select("circuit", F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("dom"), "total_volume")
    return own.rollup("circuit", "year", "month", "dom").agg(F.sum("total_volume").alias("volume"))


def cluster_stats(events: DataFrame) -> DataFrame:
    own = events.where("cluster_id is not null").groupBy("circuit", "cluster_id")
    return own.agg(F.count("*").alias("event_count"), F.avg("volume_litres").alias("avg_volume"), F.avg("duration_seconds").alias("avg_duration"), F.avg("avg_flow_lpm").alias("avg_flow"), F.max("start_ts").alias("last_seen"))


def hour_profile(hourly: DataFrame, least: int = 7) -> DataFrame:
    """Average volume by circuit and hour of the day, for hours with at least that many rows."""
    return hourly.groupBy("circuit", F.hour("hour_ts").alias("hr")).agg(F.avg("volume").alias("avg_volume"), F.count("*").alias("n")).where(F.col("n") >= least)


def quiet_hour(profile: DataFrame) -> DataFrame:
    """(circuit, hr): hours in order of (average, hour); a later one is taken if under 0.95 of the best, or under 1.05 of it and from 0 to 5."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("avg_volume").alias("a"), F.col("hr").alias("h"))))
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("int").alias("h"))

    def better(best: Column, x: Column) -> Column:
        take = best["a"].isNull() | (x["a"] < 0.95 * best["a"]) | ((x["a"] < 1.05 * best["a"]) & x["h"].between(0, 5))
        return F.when(take, F.struct(x["a"].alias("a"), x["h"].cast("int").alias("h"))).otherwise(best)

    return profile.groupBy("circuit").agg(F.aggregate(rows, start, better)["h"].alias("hr"))


def quality_metrics(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per circuit: clusters with members, share of events matched (in percent), unmatched events, mean suggested confidence."""
    seen = events.groupBy("circuit").agg(F.count("*").alias("events"), F.count("cluster_id").alias("matched"))
    own = clusters.groupBy("circuit").agg(F.count_if(F.col("member_count") > 0).alias("cluster_count"), F.avg("suggested_confidence").alias("avg_confidence"))
    share = F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("events")), F.lit(0.0))
    return seen.join(own, "circuit", "left").select("circuit", "cluster_count", F.round(share, 4).alias("coverage"), (F.col("events") - F.col("matched")).alias("unmatched"), "avg_confidence")


def counter_delta(readings: DataFrame, group: list[str], ts: str, value: str, most: float = 10000.0, tie: str = "id") -> DataFrame:
    """(group, delta): last minus first value of a counter (ties by id), where there are two readings and 0 < delta < most; else null."""
    place = F.struct(ts, tie)
    own = readings.groupBy(*group).agg((F.max_by(value, place) - F.min_by(value, place)).alias("d"), F.count(value).alias("n"))
    return own.select(*group, F.when((F.col("n") >= 2) & (F.col("d") > 0) & (F.col("d") < most), F.round("d", 3)).alias("delta"))


def day_series(hourly: DataFrame, circuits: DataFrame, as_of: Column) -> DataFrame:
    """The 24 hours that end with as_of's, hour by hour, 0 where nothing flowed."""
    last = F.date_trunc("hour", as_of)
    slots = circuits.select("circuit", F.explode(F.sequence(last - F.expr("interval 23 hours"), last, F.expr("interval 1 hour"))).alias("hour_ts"))
    slots = slots.withColumn("hour_ts", F.col("hour_ts").cast(dict(hourly.dtypes)["hour_ts"]))
    return slots.join(hourly, ["circuit", "hour_ts"], "left").select("circuit", "hour_ts", F.round(F.coalesce("volume", F.lit(0.0)), 2).alias("volume"))


def year_over_year(daily: DataFrame, months: int = 12) -> DataFrame:
    """Each day beside the same day ``months`` months before (a day that month lacks is its last one)."""
    prior = daily.select("circuit", F.add_months("day", months).alias("day"), F.col("total_volume").alias("prior"))
    prior = prior.groupBy("circuit", "day").agg(F.sum("prior").alias("prior_volume"))
    return daily.join(prior, ["circuit", "day"], "left").select("circuit", "day", "total_volume", "prior_volume")


def table_sizes(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(name, rows, bytes): row counts with a size estimate from bytes per row."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", (F.col("rows") * size).alias("bytes")) for n, (df, size) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
