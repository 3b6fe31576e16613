"""Connected components of an edge table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u is tied to u's least neighbour or u. Small: u and its smaller ones are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    tied = near.where("v > u") if large else near
    pairs = tied.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        pairs = pairs.unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, root): the least node that each node of an edge can reach. Nodes are of one orderable type."""
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        edges = checkpointed(_star(_star(edges, True), False))
