"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for nodes with an edge.

    ``edges`` has long columns ``a`` and ``b``; direction, loops and repeats do
    not matter.  Each round hangs every neighbour larger than a node on the
    node's smallest neighbour, then every smaller neighbour likewise; the edges
    never grow, and chains shrink by halves.  Rounds are written to the shared
    folder, so no link leaves the executors and lineage stays short.
    """
    pairs = (
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    )
    pairs = stored(pairs, "edges")
    for _ in range(max_rounds):
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(pairs.select("lo", "hi"))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("low").alias("lo")),
                                      F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct()
        )
        after = stored(small, "edges")
        left = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        was = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        pairs = after
        if left == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select("lo").distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )
