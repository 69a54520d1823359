"""Connected components of a graph that is spread over the cluster.

Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and beyond", 2014): the number
of rounds grows with the logarithm of the longest path. Each round is grouped minima and equi-joins, so a hub is pre-aggregated
before its shuffle and its join partition can be split; nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import released, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of an edge that isn't its component's least node; the least node is the root.

    edges: any number of rows of two comparable columns of one type, in either direction, repeats and loops allowed; rows with a
    null are no edges. An empty table gives an empty result.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before = mark, now
        now = written(_small_star(_large_star(before)))
        released(before)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
