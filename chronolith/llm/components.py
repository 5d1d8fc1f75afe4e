"""Connected components of a link table by alternating large and small stars.

Every round is joins and aggregations; only two numbers per round reach the driver. The smallest neighbour of every node is
stored before it is joined back, so that both sides of the join are plain shuffles and the links of a hub can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``links`` (a, b): the smallest node reachable.

    Self-links and nulls are dropped, repeated links count once. An empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges), "stars")), "links")
        if (now := _state(edges)) == state:
            break
        state = now
    # Now every edge leads from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
    rest = edges.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("k", "m")).distinct()
