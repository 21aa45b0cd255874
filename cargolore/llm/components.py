"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins over the edges, so no task ever
holds a component.  A node's smallest neighbour is aggregated before the shuffle;
the edges of hot nodes are spread over several tasks by ``hot_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.llm.common import hot_join, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the
    undirected ``edges`` ``u, v`` (whole numbers).  No edges, no rows."""
    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(state)
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "least")
        # each larger neighbour of a node is linked to the node's smallest
        large = hot_join(both.where("v > u"), least.where("n > 0"), ["u"], "n", F.xxhash64("v"), total=before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lowest")
        small = hot_join(large, low, ["u"], "n", F.xxhash64("v"), total=before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        after = _mark(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
