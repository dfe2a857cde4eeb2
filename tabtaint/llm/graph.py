"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.common import sized, stored


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"]


def _toward_least(near: DataFrame, keep, n: int) -> DataFrame:
    """Each kept neighbour of a node is tied to the least of the node and its neighbours.

    The minimum is pre-aggregated and joined back, so a node with very many neighbours is split
    like any skewed join key."""
    least = sized(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n)
    return near.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns ``u``, ``v``); the component is its
    least node.  Every round is written to the shared store; the number of rounds follows the
    logarithm of the largest component's size."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "edges")
    before = _signature(e)
    n = before[0]
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sized(_toward_least(both, F.col("v") > F.col("u"), 2 * n).where("u <> v").distinct(), n)
        small = _toward_least(large, F.lit(True), n) \
            .unionByName(sized(large.groupBy("u").agg(F.min("v").alias("v")), n)).where("u <> v") \
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = stored(sized(small, n), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
