"""Connected components of an edge table by alternating large-star and small-star steps.

Everything is a DataFrame join or aggregation; each round is written to the shared folder, so lineage stays
short and a lost executor costs a re-read. The neighbours of a node are never gathered: only their minimum is
aggregated (with map-side combination) and joined back, and a hot node's rows are split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Steps


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, root) for every node of the edges (u, v) that isn't its component's smallest; ids are longs.

    The result is one of the steps; those of earlier rounds are dropped.
    Loops, nulls and repeated edges are ignored; an edge table without rows gives no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges = steps.stored(edges, "edges")
    state = _state(edges)
    while state[0]:
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of a node, and itself, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = large.join(least, "u")
        small = pair.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, edges = edges, steps.stored(small.distinct(), "edges")
        steps.drop(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
