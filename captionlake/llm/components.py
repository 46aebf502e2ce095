"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to the least node around it: its larger neighbours (both), or itself
    and its smaller ones."""
    pairs = edges.select("a", "b")
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
    least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = sides.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable; nodes without edges aren't listed.
    Each round is written to the shared scratch folder, so a lost executor costs one round at most."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = None
    while True:
        now = stored(_star(_star(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
