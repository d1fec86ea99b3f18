"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, root) for each node of edges (a, b), with the least node of its component as root.

    A node's neighbours are never gathered: each step is a minimum per node, joined back to its edges. Every step
    is written to the shared folder; the number of steps grows with the logarithm of the component. Steps end when no
    edge has changed; edges that still change after ``most`` of them raise.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written first: adaptive execution splits a hot node's edges only if the other side is no aggregate
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima")
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "edges")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        then = stored(small, "edges")
        mark = then.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        for old in (now, low, large, least):
            dropped(spark, old)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not settled after {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
