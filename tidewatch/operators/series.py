"""Ordered series per key without one task per key: time buckets carry what a later bucket must know of the earlier ones.

A plain window over (key, time) puts all rows of a key in one task, and one key may hold a third of a table. Here rows are dealt by (key,
time bucket); one small aggregate per bucket gives what went before it. Row frames are dealt by (key, block of rows), each
block with the few rows before it that its frames reach. Timestamps are read in the session time zone, which should be UTC.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket, and rows of a block.
BUCKET, BLOCK = 6 * 3600, 4096


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def running(df: DataFrame, key: str, order: list[str], values: Mapping[str, tuple[str, Column]], before: bool = False, bucket: int = BUCKET) -> DataFrame:
    """df with one column per name of values: the sum, max, min or last of the column over all rows of the key up to this one.

    order starts with a timestamp and must be unique within a key; kinds are sum, max, min and last (which skips nulls). With before, the row itself
    does not count. Keys and timestamps that are null form series of their own.
    """
    inputs = {f"__v_{n}": c for n, (_, c) in values.items()}
    own = df.withColumns({"__run_bucket": F.floor(seconds(F.col(order[0])) / bucket), **inputs})
    place = F.struct(*order)
    kinds = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    totals = own.groupBy(key, "__run_bucket").agg(*[kinds[k](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(key).orderBy("__run_bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c), "last": lambda c: F.last(c, ignorenulls=True)}
    carried = totals.select(F.col(key).alias("__run_key"), F.col("__run_bucket").alias("__run_cell"), *[over[k](f"__t_{n}").over(earlier).alias(f"__p_{n}") for n, (k, _) in values.items()])
    joined = own.join(carried, F.col(key).eqNullSafe(F.col("__run_key")) & F.col("__run_bucket").eqNullSafe(F.col("__run_cell")), "left")
    inside = Window.partitionBy(key, "__run_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    put = {}
    for n, (k, _) in values.items():
        here, gone = over[k](f"__v_{n}").over(inside), F.col(f"__p_{n}")
        put[n] = F.when(here.isNull(), gone).when(gone.isNull(), here).otherwise(here + gone) if k == "sum" else F.greatest(here, gone) if k == "max" else F.least(here, gone) if k == "min" else F.coalesce(here, gone)
    return joined.withColumns(put).drop("__run_bucket", "__run_key", "__run_cell", *inputs, *[f"__p_{n}" for n in values])


def previous(df: DataFrame, key: str, order: list[str], columns: Mapping[str, str], bucket: int = BUCKET) -> DataFrame:
    """df with the values that columns (new name: old name) had in the row before, nulls kept; null in the first row."""
    out = running(df, key, order, {"__prev": ("last", F.struct(*[F.col(c).alias(n) for n, c in columns.items()]))}, before=True, bucket=bucket)
    return out.withColumns({n: F.col(f"__prev.{n}") for n in columns}).drop("__prev")


def numbered(df: DataFrame, key: str, order: list[str], name: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """df with the place of each row in its key's series, from 1."""
    return running(df, key, order, {name: ("sum", F.lit(1).cast("long"))}, bucket=bucket)


def framed(df: DataFrame, key: str, order: list[str], frames: Mapping[str, tuple[str, Column | str, int, int]], bucket: int = BUCKET, block: int = BLOCK, placed: bool = False) -> DataFrame:
    """df with pos and one column per name of frames: (avg, count, sum, max, first or list, without nulls) of a column over rows start..end (both at most 0).

    With placed, df has pos already.
    """
    reach = max(-start for _, _, start, _ in frames.values())
    if reach >= block:
        raise ValueError("a frame reaches beyond a block")
    own = (df if placed else numbered(df, key, order, "pos", bucket)).withColumn("__blk", F.floor((F.col("pos") - 1) / block))
    late = (F.col("pos") - 1) % block >= block - reach
    dealt = own.withColumn("__at", F.explode(F.when(late, F.array("__blk", F.col("__blk") + 1)).otherwise(F.array("__blk"))))
    window = Window.partitionBy(key, "__at").orderBy("pos")
    use = {"avg": F.avg, "count": F.count, "sum": F.sum, "max": F.max, "first": F.first, "list": F.collect_list}
    out = dealt.withColumns({n: use[k](c).over(window.rowsBetween(a, b)) for n, (k, c, a, b) in frames.items()})
    return out.where(F.col("__at") == F.col("__blk")).drop("__blk", "__at")


def islands(df: DataFrame, key: str, order: list[str], starts: Column, name: str = "island", bucket: int = BUCKET) -> DataFrame:
    """df with a run number that grows by one at each row for which starts holds."""
    return running(df, key, order, {name: ("sum", F.when(starts, 1).otherwise(0).cast("long"))}, bucket=bucket)
