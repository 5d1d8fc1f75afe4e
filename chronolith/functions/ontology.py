"""The ontology: node types, edge types with the types of their ends, and checks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node types, and the types that each edge's ends may have.
NODE_TYPES = ["person", "event", "place", "artwork", "heritage", "media", "org", "period", "role"]
EDGE_TYPES = {
    "participated_in": (["person", "org"], ["event"]),
    "occurred_at": (["event"], ["place"]),
    "occurred_during": (["event"], ["period"]),
    "born_in": (["person"], ["place"]),
    "died_in": (["person"], ["place"]),
    "created": (["person", "org"], ["artwork", "heritage"]),
    "located_in": (["heritage", "artwork", "place"], ["place"]),
    "depicts": (["media", "artwork"], ["person", "event", "place"]),
    "child_of": (["person"], ["person"]),
    "spouse_of": (["person"], ["person"]),
    "member_of": (["person"], ["org"]),
    "held_position": (["person"], ["role", "org"]),
    "from_period": (["heritage", "artwork", "person", "event"], ["period", "org"]),
    "dated_to": (NODE_TYPES, ["period"]),
    "part_of": (NODE_TYPES, NODE_TYPES),
    "related_to": (NODE_TYPES, NODE_TYPES),
}

NODE_FIELDS = "id string, type string, label string, source string, start_date string, end_date string, lat double, lon double, description string, url string, props string"
EDGE_FIELDS = "src string, dst string, type string, source string, label string, start_date string, end_date string, confidence double, props string"


def edge_rules(spark: SparkSession) -> DataFrame:
    """``type, from_types, to_types``: sixteen rows, small enough to broadcast."""
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in EDGE_TYPES.items()], "type string, from_types array<string>, to_types array<string>"))


def node_violation(type_: Column, id_: Column, label: Column) -> Column:
    return F.when(~type_.isin(NODE_TYPES) | type_.isNull(), "type").when(~F.contains(id_, F.lit(":")) | id_.isNull(), "id").when(F.coalesce(label, F.lit("")) == "", "label")


def edge_violation(type_: Column, confidence: Column) -> Column:
    return F.when(~type_.isin(list(EDGE_TYPES)) | type_.isNull(), "type").when(~((confidence > 0) & (confidence <= 1)) | confidence.isNull(), "confidence")


def with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``src_type`` and ``dst_type``, null where a node is missing."""
    kinds = nodes.select("id", F.col("type").alias("kind"))
    out = edges.join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("src_type")), "src", "left")
    return out.join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("dst_type")), "dst", "left")


def endpoint_problems(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends have types that their own type does not allow; missing nodes are no problem here."""
    typed = with_end_types(edges, nodes).join(edge_rules(edges.sparkSession), "type")
    problem = F.when(~F.array_contains("from_types", F.col("src_type")), "src").when(~F.array_contains("to_types", F.col("dst_type")), "dst")
    return typed.where("src_type is not null and dst_type is not null").withColumn("problem", problem).where("problem is not null").drop("from_types", "to_types")


def oriented(edges: DataFrame) -> DataFrame:
    """Edges (with end types) that fit the ontology as they are or turned round; ``flipped`` tells which."""
    typed = edges.join(edge_rules(edges.sparkSession), "type")
    fits = F.array_contains("from_types", F.col("src_type")) & F.array_contains("to_types", F.col("dst_type"))
    turned = F.array_contains("from_types", F.col("dst_type")) & F.array_contains("to_types", F.col("src_type"))
    return typed.withColumn("flipped", F.when(fits, False).when(turned, True)).where("flipped is not null").drop("from_types", "to_types")
