"""Merging batches into the graph's tables, deleting from them, and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(old: DataFrame, new: DataFrame, keys: list[str], first: list[str], filled: list[str], last: list[str]) -> DataFrame:
    """One aggregation over old and new rows in their order; ``new`` has ``seq``, its order within the batch."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    aggs = [F.expr(f"min_by(struct(`{c}`), seq)")[c].alias(c) for c in first]
    aggs += [F.expr(f"max_by(`{c}`, seq) filter (where `{c}` is not null)").alias(c) for c in filled]
    aggs += [F.expr(f"max_by(struct(`{c}`), seq)")[c].alias(c) for c in last]
    return rows.groupBy(*keys).agg(*aggs).select(*old.columns)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Type and source stay; label and props are the newest; the rest is the newest that is not null."""
    return _merged(old, new, ["id"], ["type", "source"], ["start_date", "end_date", "lat", "lon", "description", "url"], ["label", "props"])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dates stay; label, confidence and props are the newest."""
    return _merged(old, new, ["src", "dst", "type", "source"], ["start_date", "end_date"], [], ["label", "confidence", "props"])


def insert_aliases(old: DataFrame, nodes: DataFrame) -> DataFrame:
    """New aliases of nodes (id, label, aliases) that are neither empty nor the label."""
    new = nodes.select(F.col("id").alias("node_id"), "label", F.explode("aliases").alias("alias")).where("alias <> '' and alias <> label")
    return old.union(new.select("node_id", "alias")).distinct()


def replace_same_as(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links by (a, b), the newest of each; ``new`` has ``seq``."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    return rows.groupBy("a", "b").agg(F.max_by("method", "seq").alias("method"), F.max_by("score", "seq").alias("score"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes ``ids`` (id), their edges and aliases; identity links are left as they are."""
    ids = ids.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), edges, aliases.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti")


def counts(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node, or null: one pass over the edges, with a flag for each end."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(end)).distinct().withColumn(f"{end}_known", F.lit(True)), end, "left")
    return out.where("src_known is null or dst_known is null").select(*edges.columns)


def stats(nodes: DataFrame, edges: DataFrame, same_as: DataFrame) -> DataFrame:
    """``metric, key, n``: totals, counts by type and source, and edges an end of which is missing."""
    def total(name: str, table: DataFrame) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "n")

    def by(name: str, table: DataFrame, key: str) -> DataFrame:
        return counts(table, key).select(F.lit(name).alias("metric"), F.col(key).alias("key"), "n")

    parts = [total("nodes", nodes), total("edges", edges), total("same_as", same_as), by("node_type", nodes, "type"), by("edge_type", edges, "type"), by("source", nodes, "source"), total("dangling", dangling(edges, nodes))]
    return reduce(DataFrame.union, parts)


def first_by(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an explicit order."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
