"""Connected components of an undirected graph, without collecting any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import stage_table


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): component is the least node of each connected component.

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the logarithm
    of a component. A hub is never collected: each step joins nodes with their least neighbour. Nodes come only
    from edges; null ends are ignored, an empty table gives an empty result.
    """
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = now.where("u = v").select("u").distinct()
    now = stage_table(now.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = stage_table(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    parents = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(now.select("u").unionByName(now.select(F.col("v").alias("u"))).distinct(), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return parents.unionByName(roots).unionByName(alone)
