"""Connected components of an edge table, without gathering any node's neighbours in one place."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lower_neighbour(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) together with the smallest node ``m`` among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root the smallest node of its component.

    Alternates two steps until nothing changes: each node's larger neighbours, then
    its smaller ones, are hung on the smallest node around it.  Minima are combined
    before the shuffle, and a node with many neighbours is split by the skew join.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lower_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lower_neighbour(large)
        now = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        gc.collect()  # a long loop: lets Spark drop the plans and shuffle files of earlier rounds
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
