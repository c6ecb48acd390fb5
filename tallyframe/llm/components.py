"""Connected components by alternating large and small stars.

The edge set is a table; each round replaces it by another one with the same
components.  A vertex with very many neighbours is never gathered: a round
needs the smallest neighbour only (an aggregate with partial sums in the map
tasks) and a join on the vertex, whose large side Spark splits when skewed.
The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, materialize

MAX_ROUNDS = 64


def _settled(edges: DataFrame) -> bool:
    """Stars only: every larger end has one smaller one, which is a larger
    end nowhere."""
    ends = (edges.select(F.col("hi").alias("v"), F.lit(1).alias("over"), F.lit(0).alias("under"))
            .unionAll(edges.select(F.col("lo").alias("v"), F.lit(0).alias("over"), F.lit(1).alias("under")))
            .groupBy("v").agg(F.sum("over").alias("over"), F.max("under").alias("under")))
    return not ends.agg(F.max((F.col("over") > 1) | (F.col("over") > 0) & (F.col("under") > 0))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of one orderable type, the ends.  Returns
    (node, root) for every node of an edge between different ends; root is
    the smallest node reachable.  Loops, repeated edges and edges with a
    null end change nothing; no edges give an empty table."""
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    pairs = (edges.where((a != b) & a.isNotNull() & b.isNotNull())
             .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    now = materialize(pairs, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        # large star: larger neighbours of a node go to its smallest neighbour
        low = (now.select(F.col("lo").alias("u"), F.col("lo").alias("v"))
               .unionAll(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
               .groupBy("u").agg(F.min("v").alias("m")))
        large = (now.join(low, now["lo"] == low["u"]).select("hi", F.col("m").alias("lo")).distinct())
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours go to the smallest
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = (large.alias("e").join(least.alias("g"), F.col("e.hi") == F.col("g.hi"))
                 .where(F.col("e.lo") != F.col("g.m")).select(F.col("e.lo").alias("hi"), F.col("g.m").alias("lo")))
        small = materialize(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        discard(now, large)
        now = small
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct())
