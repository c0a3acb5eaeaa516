"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join over edges; nothing is collected. Each round is written
to the shared folder, which cuts lineage and survives lost executors; the round before it then goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.store import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b), kept; the component is its least node."""
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        last, now = now, keep(small_star(large_star(now)), "stars")
        drop(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(now)
    return out


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
