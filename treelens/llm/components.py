"""Connected components of an edge table, all on the executors.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
joins a node's neighbours to the least of them, until the edges are stars whose
centres are the smallest node of each component. Minima are taken by partial
aggregation, so a hub with very many neighbours is no single task's burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import cut, free

#: Edges of a partition, at most: few edges need few tasks in every step.
EDGES_PER_PARTITION = 100_000


def _both(edges: DataFrame) -> DataFrame:
    pair = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )
    return edges.select(F.explode(pair).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("a"), F.col("m").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(
        F.col("v").alias("a"), F.col("m").alias("b")
    )
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs, a <> b."""
    parts = -(-edges.count() // EDGES_PER_PARTITION) or 1
    now, state = cut(_proper(edges.select("a", "b"), parts)), None
    while True:
        now = cut(_proper(_small_star(_large_star(now)), parts))
        seen = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
        free(edges.sparkSession)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(centres)


def _proper(edges: DataFrame, parts: int) -> DataFrame:
    """Distinct edges between different nodes, in at most ``parts`` partitions."""
    return edges.filter(F.col("a") != F.col("b")).coalesce(parts).distinct().coalesce(parts)
