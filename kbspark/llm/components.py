"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kbspark.llm.common import written


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and a sum over them that tells two edge sets apart."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")))
    return table, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b), where root is the smallest id that links reach.

    Nothing is collected: each step is a join of edges with the least neighbour of one end, and stops
    when a round changes nothing. The least neighbours are written before the join, so both sides are
    dealt out anew and Spark can split the partition of an id with very many edges.
    """
    e, state = _counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(e.join(least, e.a == least.u).select(F.col("m").alias("a"), "b").where("a < b").distinct())
        least = written(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"))
        moved = large.join(least, large.b == least.u).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
        e, now = _counted(moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        if now == state:
            break
        state = now
    return e.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
