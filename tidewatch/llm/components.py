"""Connected components of a set of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, release


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Each round keeps at most as many rows as there are links. Nulls and self-links are ignored, repeated links count once,
    an empty input gives an empty output. Raises if it has not settled after max_rounds (2 ** 30 hops would).
    """
    edges = materialize(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialize(small.distinct(), "cc")
        release(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = materialize(out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
            release(edges)
            return out
        before = now
    raise RuntimeError("components did not settle")
