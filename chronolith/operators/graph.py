"""Neighbourhoods, degrees, closures and era subgraphs, as joins over edge tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import SMALL, counted, cut


@dataclass
class Subgraph:
    nodes: DataFrame
    edges: DataFrame
    same_as: DataFrame
    truncated: bool


def incidence(edges: DataFrame) -> DataFrame:
    """``id, other`` from both ends of every edge; a self-loop counts once. An OR join would be a nested loop."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other")))


def _touching(table: DataFrame, a: str, b: str, frontier: DataFrame, rows: int) -> DataFrame:
    """Rows with an end in a frontier of so many ids: one pass over the table if the frontier can be sent to all tasks.

    A larger one is shuffled: its semi joins reach the scan below a union, and rows with both ends in it come twice.
    """
    if rows <= SMALL:
        own = F.broadcast(frontier.select("id").distinct())
        hit = table.join(own.select(F.col("id").alias("_a")), F.col(a) == F.col("_a"), "left").join(own.select(F.col("id").alias("_b")), F.col(b) == F.col("_b"), "left")
        return hit.where("_a is not null or _b is not null").drop("_a", "_b")
    return table.join(frontier.select(F.col("id").alias(a)), a, "left_semi").unionByName(table.join(frontier.select(F.col("id").alias(b)), b, "left_semi"))


def _ends(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select(F.col(a).alias("id")).union(table.select(F.col(b).alias("id")))


def neighbors(nodes: DataFrame, edges: DataFrame, same_as: DataFrame, node_id: str, depth: int = 1, max_nodes: int = 3000, follow_same_as: bool = True) -> Subgraph:
    """Everything within ``depth`` steps of a node, at most ``max_nodes`` ids, the smallest of the last layer first.

    Edges between two nodes of the outermost layer were never met on the way and are not part of it; parallel edges of
    one type come back once, from the greatest source. The edges that a hop touches are stored, and the result is made of these. A hop
    scans the edges once, so edges that are costly to compute should be stored first.
    """
    spark = nodes.sparkSession
    seen = frontier = spark.createDataFrame([(node_id,)], "id string")
    met, same = edges.limit(0), same_as.limit(0)
    size, layer, truncated = 1, 1, False
    for _ in range(depth):
        touched = cut(_touching(edges, "src", "dst", frontier, layer))
        met, ends = met.union(touched), _ends(touched, "src", "dst")
        if follow_same_as:
            linked = cut(_touching(same_as, "a", "b", frontier, layer))
            same, ends = same.union(linked), ends.union(_ends(linked, "a", "b"))
        fresh = cut(ends.distinct().join(counted(seen, size), "id", "left_anti"))
        layer = fresh.count()
        if size + layer > max_nodes:
            fresh, truncated, layer = fresh.orderBy("id").limit(max_nodes - size), True, max_nodes - size
        seen, frontier, size = seen.union(fresh), fresh, size + layer
        if truncated or not layer:
            break
    seen = counted(cut(seen), size)

    def inside(table: DataFrame, a: str, b: str) -> DataFrame:
        return table.join(seen.select(F.col("id").alias(a)), a, "left_semi").join(seen.select(F.col("id").alias(b)), b, "left_semi").select(*table.columns)

    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    kept = inside(met, "src", "dst").groupBy("src", "dst", "type").agg(F.max_by(F.struct(*rest), "source").alias("r")).select("src", "dst", "type", *(F.col(f"r.{c}").alias(c) for c in rest))
    return Subgraph(nodes.join(seen, "id", "left_semi"), kept.select(*edges.columns), inside(same, "a", "b").distinct(), truncated)


def expand(seeds: DataFrame, edges: DataFrame, same_as: DataFrame, hops: int = 1, only_linked: bool = False) -> DataFrame:
    """Seeds (id) and all within ``hops`` steps, identity links included.

    ``only_linked``: without seeds that no edge or link touches. The first hop meets all others, so there is no further scan; without
    hops all seeds stay.
    """
    seen = frontier = cut(seeds.select("id").distinct())
    size = layer = seen.count() if hops else 0
    for hop in range(hops):
        touched, linked = _touching(edges.select("src", "dst"), "src", "dst", frontier, layer), _touching(same_as.select("a", "b"), "a", "b", frontier, layer)
        ends = touched.select(F.explode(F.array("src", "dst")).alias("id")).union(linked.select(F.explode(F.array("a", "b"))))  # joins run once for both ends
        if only_linked and hop == 0:
            met = cut(ends.distinct())
            if hops == 1:
                return met
            frontier = cut(met.join(counted(seen, size), "id", "left_anti"))
            layer, seen, size = frontier.count(), met, met.count()
        else:
            frontier = cut(ends.distinct().join(counted(seen, size), "id", "left_anti"))
            layer = frontier.count()
            seen, size = seen.union(frontier), size + layer
    return seen


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(incidence(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def gazetteer(nodes: DataFrame, edges: DataFrame, limit: int = 150, types: tuple[str, ...] = ("person", "event", "place", "period"), scope: DataFrame | None = None) -> DataFrame:
    """``type, rank, label``: the best connected labels of each type."""
    found = degree(nodes.where(F.col("type").isin(*types) & (F.length("label") >= 2)), edges)
    if scope is not None:
        found = found.join(scope.select("id"), "id", "left_semi")
    order = Window.partitionBy("type").orderBy(F.desc("degree"), F.length("label"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("type", "rank", "label")


def era_seeds(nodes: DataFrame, edges: DataFrame, same_as: DataFrame, polity: str, polity_id: str) -> DataFrame:
    """Ids that belong to an era: persons and events by their props, and what is dated to its polity, directly or by identity."""
    persons = nodes.where((F.col("type") == "person") & (F.get_json_object("props", "$.polity") == polity)).select("id")
    events = nodes.where((F.col("type") == "event") & (F.get_json_object("props", "$.seed_era") == polity)).select("id")
    dated = edges.where("type = 'from_period'")
    through = dated.join(same_as.where(F.col("b") == polity_id).select(F.col("a").alias("dst")), "dst", "left_semi")
    return persons.union(events).union(dated.where(F.col("dst") == polity_id).select("src")).union(through.select("src")).distinct()


def isolated(ids: DataFrame, edges: DataFrame, same_as: DataFrame) -> DataFrame:
    """Ids that no edge and no identity link touches, in the whole store."""
    touched = incidence(edges).select("id").union(incidence(same_as.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select("id"))
    return ids.join(touched, "id", "left_anti")


def scope(nodes: DataFrame, edges: DataFrame, same_as: DataFrame, polity: str, polity_id: str, hops: int = 1, drop_isolated: bool = True, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The induced subgraph of an era: nodes, edges and identity links whose ends are both kept; ``seeds``: the era's, if they are known."""
    seeds = era_seeds(nodes, edges, same_as, polity, polity_id) if seeds is None else seeds
    own = nodes.sparkSession.createDataFrame([(polity_id,)], "id string")
    if drop_isolated and hops:  # what hops reach is not isolated, which leaves the polity to be looked up
        linked = _ends(edges, "src", "dst").union(_ends(same_as, "a", "b")).where(F.col("id") == polity_id)
        keep = expand(seeds, edges, same_as, hops, only_linked=True).union(linked).distinct()
    else:
        keep = expand(seeds, edges, same_as, hops).union(own).distinct()
        if drop_isolated:
            keep = keep.join(isolated(keep, edges, same_as), "id", "left_anti")
    keep = cut(keep)

    def both(table: DataFrame, a: str, b: str) -> DataFrame:
        return table.join(keep.withColumnRenamed("id", a), a, "left_semi").join(keep.withColumnRenamed("id", b), b, "left_semi").select(*table.columns)

    return nodes.join(keep, "id", "left_semi"), both(edges, "src", "dst"), both(same_as, "a", "b")


def closure(instances: DataFrame, subclasses: DataFrame) -> DataFrame:
    """``id, class``: every class of an instance (id, class), up any number of subclass steps (class, parent), cycles allowed."""
    seen = frontier = instances.select("id", "class").distinct()
    while True:
        up = frontier.join(subclasses, "class").select("id", F.col("parent").alias("class")).distinct()
        frontier = cut(up.join(seen, ["id", "class"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))
