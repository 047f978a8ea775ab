"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.staging import staged



def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``links`` (u, v: two longs).

    Large-star and small-star steps alternate until every node hangs on its smallest: each node sends its neighbours
    to the smallest one it knows.  A step is a minimum and an equi-join on numbers; hubs are split as skewed joins,
    because both sides of the join are stored tables.  The number of steps grows with the log of the longest chain.
    """
    edges = staged(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(edges)
    while before[0]:
        both = _both_ways(edges)
        low = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")))
        large = staged(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        )
        low = staged(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = staged(small.union(low.select("u", F.col("low").alias("v"))).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
