"""Interval operators: coalescing, range joins, nearby rows and as-of joins, all as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.series import islands, running, seconds
from tidewatch.sources.history import kept


def coalesce_intervals(df: DataFrame, key: str, start: str, end: str, tie: str, gap_seconds: float = 15.0, min_seconds: float = 0.0) -> DataFrame:
    """(key, start, end, n_merged): intervals of a key at most gap_seconds apart become one (a gap of exactly that merges).

    Which intervals open a new one is written once, so that the pass that numbers them does not read the input again.
    """
    own = df.select(key, start, end, tie)
    reach = running(own, key, [start, tie], {"__reach": ("max", seconds(F.col(end)))}, before=True)
    opens = F.col("__reach").isNull() | (seconds(F.col(start)) > F.col("__reach") + gap_seconds)
    marked = kept(reach.select(key, start, end, tie, opens.alias("__opens")), "intervals")
    grouped = islands(marked, key, [start, tie], F.col("__opens"), "__island").groupBy(key, "__island")
    out = grouped.agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")
    return out.where(seconds(F.col(end)) - seconds(F.col(start)) >= min_seconds) if min_seconds else out


def _cells(low, high, width: int):
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def range_join(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, before_seconds: float = 0.0, bucket: int = 3600) -> DataFrame:
    """spans joined with the points of the same key with start - before_seconds <= ts <= end; points come as the struct ``point``.

    Spans are spread over the time buckets they touch, so Spark joins by (key, bucket) and a residual range. A pair is
    found in one bucket only, that of the point.
    """
    wide = spans.withColumn("__low", seconds(F.col(start)) - before_seconds).withColumn("__high", seconds(F.col(end)))
    dots = points.select(F.col(key).alias("__key"), F.floor(seconds(F.col(ts)) / bucket).alias("__cell"), seconds(F.col(ts)).alias("__t"), F.struct(*points.columns).alias("point"))
    spread = wide.withColumn("__c", _cells(F.col("__low"), F.col("__high"), bucket))
    hit = (F.col(key) == F.col("__key")) & (F.col("__c") == F.col("__cell")) & F.col("__t").between(F.col("__low"), F.col("__high"))
    return spread.join(dots, hit).drop("__low", "__high", "__key", "__cell", "__c", "__t")


def range_means(spans: DataFrame, points: DataFrame, key: str, tie: str, start: str, end: str, ts: str, value: str, before_seconds: float) -> DataFrame:
    """(tie, key, n, inside, baseline) of range_join() by key and tie, without its pairs: the number of points of each span, and the means of value from start
    on and up to start.

    The ends of a span are rows of the points' series, where running sums are read; a span costs four rows, however many points it holds. Sums are decimals
    of 14 places, so their differences keep small sums exact; a finite value of 1e15 and more raises. Spans without points have no row.
    """
    own = spans.where(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    low, inner = F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) - F.lit(round(before_seconds * 1_000_000))).cast(dict(points.dtypes)[ts]), F.when(F.col(end) >= F.col(start), 1).otherwise(0)
    mark = lambda at, src, n, i, b: F.struct(at.alias("__at"), F.lit(src).alias("__src"), F.lit(n).alias("__wn"), i.cast("int").alias("__wi"), F.lit(b).alias("__wb"))
    none = F.lit(0)
    marks = F.array(mark(low, 0, -1, none, -1), mark(F.col(start), 0, 0, -inner, 0), mark(F.least(F.col(start), F.col(end)), 2, 0, none, 1), mark(F.col(end), 2, 1, inner, 0))
    ends = own.where(F.col(end) >= low).select(F.col(key), F.col(tie), F.explode(marks).alias("__m")).select(key, tie, "__m.*")
    v = F.col(value).cast("double")
    up, down = F.isnan(v) | (v == float("inf")), F.isnan(v) | (v == float("-inf"))
    exact = F.when(up | down, None).when(F.abs(v) < 1e15, v.cast("decimal(30,15)")).when(v.isNotNull(), F.raise_error(F.lit("a value of 1e15 and more")).cast("decimal(30,15)"))
    count = lambda c: F.when(c, 1).otherwise(0).cast("long")
    dots = points.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), F.col(ts).alias("__at"), F.lit(1).alias("__src"), exact.alias("__v"), count(v.isNotNull()).alias("__c"), count(up).alias("__up"), count(down).alias("__down"))
    both = ends.unionByName(dots, allowMissingColumns=True)
    found = running(both, key, ["__at", "__src"], {"n": ("sum", F.when(F.col("__src") == 1, 1).otherwise(0).cast("long")), "s": ("sum", F.col("__v")), "c": ("sum", F.col("__c")), "up": ("sum", F.col("__up")), "down": ("sum", F.col("__down"))}).where("__src <> 1")
    part = lambda w, c: F.sum(F.when(F.col(w) == 1, F.col(c)).when(F.col(w) == -1, -F.col(c)))
    sums = found.groupBy(tie, key).agg(part("__wn", "n").alias("n"), *[part(w, c).alias(f"{w}_{c}") for w in ("__wi", "__wb") for c in ("s", "c", "up", "down")])

    def mean(w: str) -> Column:
        odd = F.when((F.col(f"{w}_up") > 0) & (F.col(f"{w}_down") > 0), float("nan")).when(F.col(f"{w}_up") > 0, float("inf")).when(F.col(f"{w}_down") > 0, float("-inf"))
        return F.when(F.col(f"{w}_c") > 0, F.coalesce(odd, F.col(f"{w}_s").cast("double") / F.col(f"{w}_c")))

    return sums.where("n > 0").select(tie, key, "n", mean("__wi").alias("inside"), mean("__wb").alias("baseline"))


def in_interval(rows: DataFrame, spans: DataFrame, key: str, ts: str, start: str, end: str, anti: bool = False, bucket: int = 86400) -> DataFrame:
    """The rows whose ts lies in some span of their key, both ends included; with anti the others. Rows with a null key or ts lie in none."""
    own = rows.withColumn("__cell", F.floor(seconds(F.col(ts)) / bucket))
    wide = spans.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), _cells(seconds(F.col(start)), seconds(F.col(end)), bucket).alias("__c"))
    hit = (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__c")) & F.col(ts).between(F.col("__start"), F.col("__end"))
    return own.join(wide, hit, "left_anti" if anti else "left_semi").drop("__cell")


def near(rows: DataFrame, others: DataFrame, key: str, ts: str, within_seconds: float = 30.0, anti: bool = False) -> DataFrame:
    """The rows with an other of the same key at most within_seconds away (whole seconds on both sides); with anti the others."""
    width = max(1, int(within_seconds))
    whole = lambda c: F.floor(seconds(F.col(c)))
    own = rows.withColumn("__s", whole(ts)).withColumn("__cell", F.floor(F.col("__s") / width))
    dots = others.select(F.col(key).alias("__key"), whole(ts).alias("__o")).distinct()
    dots = dots.withColumn("__c", F.explode(F.array(*[F.floor(F.col("__o") / width) + i for i in (-1, 0, 1)])))
    hit = (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__c")) & (F.abs(F.col("__s") - F.col("__o")) <= within_seconds)
    return own.join(dots, hit, "left_anti" if anti else "left_semi").drop("__s", "__cell")


def as_of(facts: DataFrame, states: DataFrame, key: str, ts: str, tie: str, state_ts: str, value: str, name: str) -> DataFrame:
    """facts with the last value of states of the same key at or before ts (null if none). tie orders facts, and states, of one time."""
    kinds = dict(facts.dtypes)
    left = facts.withColumns({"__src": F.lit(1), "__value": F.lit(None).cast(dict(states.dtypes)[value])})
    right = states.select(F.col(key), F.col(state_ts).alias(ts), F.col(tie).cast(kinds[tie]).alias(tie), F.lit(0).alias("__src"), F.col(value).alias("__value"))
    both = left.unionByName(right, allowMissingColumns=True)
    return running(both, key, [ts, "__src", tie], {name: ("last", F.col("__value"))}).where("__src = 1").drop("__src", "__value")
