"""Connected components of a link table, by alternating large-star and small-star steps on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node (large: greater ones; else smaller ones and itself) at its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, store: Store, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of edges (a, b), the least node that it reaches.

    Each round writes its table to the shared folder; only two numbers of it go to the driver. Stops when the links no
    longer change. Links with a null end are ignored. An empty table gives an empty one.
    """
    now = store.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        after = store.put(_star(_star(now, True), False), "links")
        # A set of links is the same if it has as many and none is new.
        sign = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        store.drop(now)
        now = after
        if before == sign:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
