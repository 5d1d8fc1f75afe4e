"""Batches into the store with checks in the same pass, a log of what came, and subgraphs as stores of their own."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import ontology
from ..operators import graph, store
from ..operators.lineage import cut
from .graphstore import GraphStore, Manifest

#: Problems that a report names.
NAMED = 5


@dataclass
class Report:
    """What was stored as which version, how many edges had a problem, and at most NAMED distinct problems with their counts."""

    version: int
    nodes: int
    edges: int
    problems: int
    named: list[tuple[str, int]]


def problem_kinds() -> list[tuple[str, str, str]]:
    """Edge type, end, and a node type that this end must not have: a few hundred, whatever the data."""
    return [(kind, end, t) for kind, ends in ontology.EDGE_TYPES.items() for end, allowed in zip(("src", "dst"), ends, strict=True) for t in ontology.NODE_TYPES if t not in allowed]


def problem(kind: Column, src: Column, dst: Column) -> Column:
    """``type: end node-type`` of an edge whose ends (null if unknown) its type does not allow; the source comes first."""
    rules = problem_kinds()

    def refused(end: str, of: Column) -> Column:
        table = F.create_map(*(F.lit(x) for k in ontology.EDGE_TYPES for x in (k, ",".join(t for q, e, t in rules if (q, e) == (k, end)))))
        return F.when(F.array_contains(F.split(table[kind], ","), of), F.concat(kind, F.lit(f": {end} "), of))

    return F.when(src.isNotNull() & dst.isNotNull(), F.coalesce(refused("src", src), refused("dst", dst)))


def persist(target: GraphStore, source: str, nodes: DataFrame, edges: DataFrame, ran_at: datetime, aliases: DataFrame | None = None) -> Report:
    """Store a batch of nodes and edges, and of aliases, as one version, and log it.

    Edges whose ends are nodes of the batch are checked against the ontology while they are written, by metrics that Spark observes on the
    way: there is no second scan. Problems are reported and do not keep anything out.
    """
    seen_nodes, seen_edges = Observation(), Observation()
    typed = ontology.with_end_types(edges, nodes).withColumn("_problem", problem(F.col("type"), F.col("src_type"), F.col("dst_type")))
    names = [f"{k}: {end} {t}" for k, end, t in problem_kinds()]
    counts = [F.count_if(F.col("_problem") == n).alias(f"p{i}") for i, n in enumerate(names)]
    checked = typed.observe(seen_edges, F.count(F.lit(1)).alias("rows"), F.count("_problem").alias("problems"), *counts)
    tx = target.begin()
    tx.append("nodes", nodes.observe(seen_nodes, F.count(F.lit(1)).alias("rows")))
    tx.append("edges", checked)
    if aliases is not None:
        tx.append("aliases", aliases)
    n, e = seen_nodes.get, seen_edges.get
    log = target.spark.createDataFrame([(tx.version, source, n["rows"], e["rows"], ran_at)], "version long, source string, nodes long, edges long, ran_at timestamp")
    tx.append("ingest_log", log)
    done = tx.commit()
    found = sorted((name, e[f"p{i}"]) for i, name in enumerate(names) if e[f"p{i}"])
    return Report(done.version, n["rows"], e["rows"], e["problems"], found[:NAMED])


def save_scope(source: GraphStore, target: GraphStore, polity: str, polity_id: str, hops: int = 1, drop_isolated: bool = True) -> tuple[Manifest, DataFrame]:
    """An era's subgraph as one version of a store of its own, and its statistics (metric, key, n).

    What the target held is replaced. An era without seeds is an error.
    """
    nodes, edges, same_as = (source.read(t) for t in ("nodes", "edges", "same_as"))
    seeds = cut(graph.era_seeds(nodes, edges, same_as, polity, polity_id))
    if seeds.isEmpty():
        raise LookupError(f"no node belongs to {polity}")
    own = graph.scope(nodes, edges, same_as, polity, polity_id, hops, drop_isolated, seeds)
    tx = target.begin()
    for name, rows in zip(("nodes", "edges", "same_as"), own, strict=True):
        tx.replace(name, rows)
    done = tx.commit()
    return done, store.stats(*(target.read(t, done.version) for t in ("nodes", "edges", "same_as")))


def scope_ids(target: GraphStore) -> DataFrame:
    """``id`` of every node of a stored subgraph, to narrow what is read to it."""
    return target.read("nodes").select("id")


def reset(target: GraphStore) -> Manifest:
    """All tables empty, as a new version; older ones can still be read."""
    tx = target.begin()
    tx.next.tables = {}
    return tx.commit()
