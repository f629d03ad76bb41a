"""Tables kept as folders by day, changed in place: upserts, additions and deletes that write the touched days only.

Writes use Spark's dynamic partition overwrite: tasks write beside the table, and the touched days are exchanged when the whole job has ended. A write
that fails or is killed before leaves every day as it was, and days that no row touches are never read or written. A day's rows come from one
shuffle, so a day is as many files as a shuffle has parts for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.intervals import in_interval
from tidewatch.operators.maintenance import add_volumes, replace_rows, update_fields

#: Days that one change may touch: they are listed on the driver to prune the read.
MOST_DAYS = 100_000


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def read_days(spark: SparkSession, path: str, schema: str, day: str = "day") -> DataFrame:
    """The rows of a table, none if nothing was ever written there; schema includes the day, which is last."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_days(rows: DataFrame, path: str, day: str = "day") -> None:
    """Puts rows in place of all rows of the days that they have; a null day is a day of its own."""
    rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def days_of(rows: DataFrame, day: str = "day") -> list[date | None]:
    """The days that rows touch; their number is checked, as they come to the driver."""
    found = [r[0] for r in rows.select(day).distinct().limit(MOST_DAYS + 1).collect()]
    if len(found) > MOST_DAYS:
        raise ValueError(f"a change touches more than {MOST_DAYS} days: apply it in parts")
    return found


def _in(day: str, days: list[date | None]) -> Column:
    known = [d for d in days if d is not None]
    hit = F.col(day).isin(known) if known else F.lit(False)
    return hit | F.col(day).isNull() if len(known) < len(days) else hit


def _merge(path: str, incoming: DataFrame, schema: str, day: str, merged: Callable[[DataFrame], DataFrame]) -> list[date | None]:
    spark = incoming.sparkSession
    days = days_of(incoming, day)
    if days:
        stored = read_days(spark, path, schema, day)
        write_days(merged(stored.where(_in(day, days))).select(*stored.columns), path, day)
    return days


def upsert_days(path: str, incoming: DataFrame, keys: list[str], schema: str, seq: str, day: str = "day") -> list[date | None]:
    """Insert or replace by keys (the day among them); of several incoming rows of a key that of the largest seq. Returns the days written."""
    return _merge(path, incoming, schema, day, lambda stored: replace_rows(stored, incoming.select(*stored.columns), keys, seq))


def add_days(path: str, incoming: DataFrame, keys: list[str], value: str, schema: str, day: str = "day") -> list[date | None]:
    """Additive upsert: the values of a key (the day among the keys) are summed with what is stored."""
    return _merge(path, incoming, schema, day, lambda stored: add_volumes(stored, incoming, keys, value))


def update_days(path: str, changes: DataFrame, keys: list[str], schema: str, allowed: list[str], day: str = "day") -> list[date | None]:
    """Update, else insert: the non-null fields of changes win. Fields that are not allowed raise before anything is written."""
    unknown = [c for c in changes.columns if c not in keys and c not in allowed]
    if unknown:
        raise ValueError(f"fields that may not be changed: {unknown}")
    return _merge(path, changes, schema, day, lambda stored: update_fields(stored, changes, keys))


def delete_days(spark: SparkSession, path: str, schema: str, keep: Callable[[DataFrame], DataFrame], before: date, day: str = "day") -> int:
    """Deletes, of the days up to ``before``, the rows that keep does not return; returns how many went.

    Later days are not touched. A day that keeps all its rows is not written, one that keeps none loses its folder. A null day is kept.
    """
    stored = read_days(spark, path, schema, day).where(F.col(day) <= F.lit(before))
    kept = keep(stored)
    counts = stored.groupBy(day).agg(F.count("*").alias("n")).join(kept.groupBy(day).agg(F.count("*").alias("k")), day, "left").fillna(0, ["k"]).where("k < n").limit(MOST_DAYS + 1).collect()
    if len(counts) > MOST_DAYS:
        raise ValueError(f"a delete touches more than {MOST_DAYS} days: apply it in parts")
    partly = [r[day] for r in counts if r["k"]]
    if partly:
        write_days(kept.where(_in(day, partly)), path, day)
    for gone in (r[day] for r in counts if not r["k"]):
        where, fs = _fs(spark, f"{path}/{day}={gone}")
        fs.delete(where, True)
    return sum(r["n"] - r["k"] for r in counts)


def outside_windows(ts: str, cutoff: Column, windows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What retention keeps: rows from the cutoff on, and older ones in a training window of their circuit (both ends included)."""

    def keep(rows: DataFrame) -> DataFrame:
        old = F.col(ts) < cutoff
        return rows.where(~F.coalesce(old, F.lit(False))).unionByName(in_interval(rows.where(old), windows, "circuit", ts, "started_at", "ends_at"))

    return keep


def from_cutoff(ts: str, cutoff: Column) -> Callable[[DataFrame], DataFrame]:
    """What a plain cutoff keeps: rows from it on, and those without a time."""
    return lambda rows: rows.where(F.coalesce(F.col(ts) >= cutoff, F.lit(True)))
