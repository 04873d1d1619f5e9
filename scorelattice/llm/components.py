"""Connected components of a large edge list, without collected neighbour lists.

Alternates two steps until nothing moves: every node hangs its larger
neighbours on its smallest one, then its smaller neighbours on the smallest.
Each step is a minimum per node (combined before the shuffle) and one join, so a
hub with a third of all edges is only a key that the skew join may split.  Every
round is stored, rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import staged


def _hang(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v), u > v.  With ``both`` the larger neighbours of each node move, else the smaller."""
    if both:
        seen = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = seen.join(least, "u")
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, root): every node of an edge and the smallest node it reaches.

    Null ends and loops are no edges; repeated edges count once.
    """
    now = staged(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull())
        .where("u != v")
        .distinct()
    )
    mark = None
    while True:
        now = staged(_hang(_hang(now, True), False))
        seen = now.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
