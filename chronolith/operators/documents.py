"""Prose of nodes as ranked, filtered and split documents, and what a model extracts from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr, ontology
from .graph import incidence

# Sources whose relations are structured already.
STRUCTURED = ["khs", "kowiki:infobox", "kowiki", "wd"]


def coverage(edges: DataFrame) -> DataFrame:
    """``id, types``: edge types that structured sources give a node."""
    own = edges.where(F.col("source").isin(STRUCTURED))
    both = own.select(F.col("src").alias("id"), "type").union(own.select(F.col("dst").alias("id"), "type"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("type")).alias("types"))


def worth_extracting(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (with type, description) from which a model could still get something."""
    met = incidence(edges.where("type = 'participated_in' and source = 'kowiki:infobox'")).select("id").distinct().withColumn("covered", F.lit(True))
    text = F.col("description")
    worth = F.when(F.col("type") == "heritage", text.rlike(f"(?U)(?:{expr.MAKER})")).when(F.col("type") == "event", ~(F.coalesce("covered", F.lit(False)) & (F.length(text) < 4000))).otherwise(True)
    return nodes.join(met, "id", "left").where(worth).drop("covered")


def split_documents(nodes: DataFrame, size: int = 6000, overlap: int = 400) -> DataFrame:
    """``node_id, label, text, chunk, total_chunks``."""
    chunks = nodes.select(F.col("id").alias("node_id"), "label", expr.split_chunks(F.col("description"), size, overlap).alias("c"))
    return chunks.select("node_id", "label", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk", "text"))


def pick_chunks(chunks: DataFrame, most: int, person: str = expr.PERSON_HINT, event: str = expr.EVENT_HINT) -> DataFrame:
    """The densest chunks of every document; all of them if ``most`` is 0 or less."""
    if most <= 0:
        return chunks
    order = Window.partitionBy("node_id").orderBy(F.desc("_density"), "chunk")
    return chunks.withColumn("_density", expr.hint_density(F.col("text"), person, event)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank", "_density")


def load_documents(nodes: DataFrame, edges: DataFrame, limit: int | None = None, min_score: float = 1.0, scope: DataFrame | None = None, skip_covered: bool = False, max_chunks: int = 0, types: tuple[str, ...] | None = None, hints: tuple[str, str, str] = (expr.PERSON_HINT, expr.EVENT_HINT, expr.CATALOG_HINT)) -> DataFrame:
    """Chunks of the prose most worth reading: filter, score, limit, then the coverage filter, in that order."""
    found = nodes.where("length(description) > 100")
    if types:
        found = found.where(F.col("type").isin(*types))
    if scope is not None:
        found = found.join(scope.select("id"), "id", "left_semi")
    found = found.withColumn("score", expr.narrative_score(F.col("description"), *hints)).where(F.col("score") >= min_score)
    if limit:
        found = found.orderBy(F.desc("score"), "id").limit(limit)
    if skip_covered:
        found = worth_extracting(found, edges)
    return pick_chunks(split_documents(found), max_chunks, *hints[:2])


def resolve_names(names: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names (name, kind) with ``id`` and ``type``: by label and type, by alias, by label, else a new id."""
    typed = nodes.groupBy(F.col("label").alias("name"), F.col("type").alias("kind")).agg(F.min("id").alias("id1"))
    alias = aliases.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id").groupBy(F.col("alias").alias("name")).agg(F.min(F.struct(F.col("node_id").alias("id"), "type")).alias("by_alias"))
    label = nodes.groupBy(F.col("label").alias("name")).agg(F.min(F.struct("id", "type")).alias("by_label"))
    new = F.struct(F.concat_ws(":", F.lit("ex"), "kind", "name").alias("id"), F.col("kind").alias("type"))
    found = names.join(typed, ["name", "kind"], "left").join(alias, "name", "left").join(label, "name", "left")
    best = F.coalesce(F.when(F.col("id1").isNotNull(), F.struct(F.col("id1").alias("id"), F.col("kind").alias("type"))), "by_alias", "by_label", new)
    return found.withColumn("r", best).drop("id1", "by_alias", "by_label").select("*", F.col("r.id").alias("id"), F.col("r.type").alias("type")).drop("r")


def to_graph(relations: DataFrame, nodes: DataFrame, aliases: DataFrame, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted relations.

    ``relations``: subject, subject_type, relation, object, object_type, evidence, confidence, source_node, text. A
    relation goes if its type is unknown, if a part is missing, or if ``text`` lacks its evidence; the rest is turned the
    way the ontology wants, or goes. New nodes of relations that only the ontology refuses stay.
    """
    ok = F.col("relation").isin(list(ontology.EDGE_TYPES)) & (F.col("text").isNull() | expr.evidence_supported(F.col("evidence"), F.col("text")))
    whole = F.col("subject_type").isin(ontology.NODE_TYPES) & F.col("object_type").isin(ontology.NODE_TYPES) & (F.length("subject") > 0) & (F.length("object") > 0)
    rows = relations.where(ok & whole)
    names = rows.select(F.col("subject").alias("name"), F.col("subject_type").alias("kind")).union(rows.select("object", "object_type")).distinct()
    known = resolve_names(names, nodes, aliases)
    new = known.where(F.startswith("id", F.lit("ex:"))).select("id", "type", F.col("name").alias("label"), F.lit("extract").alias("source")).join(nodes.select("id"), "id", "left_anti")
    for end, name in (("src", "subject"), ("dst", "object")):
        rows = rows.join(known.select(F.col("name").alias(name), F.col("kind").alias(f"{name}_type"), F.col("id").alias(end), F.col("type").alias(f"{end}_type")), [name, f"{name}_type"])
    fit = ontology.oriented(rows.withColumnRenamed("relation", "type"))
    props = F.to_json(F.struct("evidence", F.col("source_node").alias("extracted_from"), F.lit(model).alias("model"), F.when(F.col("flipped"), F.lit(True)).alias("flipped")))
    edges = fit.select(F.when(F.col("flipped"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("flipped"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "type", F.lit("extract").alias("source"), expr.confidence(F.col("confidence")).alias("confidence"), props.alias("props"))
    return new, edges


def extraction_quality(edges: DataFrame) -> DataFrame:
    """``type, n, linked``: extracted relations and how many of them touch no new node."""
    linked = F.sum(F.when(~F.startswith("src", F.lit("ex:")) & ~F.startswith("dst", F.lit("ex:")), 1).otherwise(0)).cast("long")
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), linked.alias("linked"))


def quality_report(edges: DataFrame, texts: DataFrame, head: int = 30) -> DataFrame:
    """``metric, n``: extracted relations, those with a new node at an end, and those whose evidence starts in its text.

    ``edges`` carry their evidence and source in ``props``; ``texts``: node_id, text.
    """
    rows = edges.select(F.get_json_object("props", "$.extracted_from").alias("node_id"), F.get_json_object("props", "$.evidence").alias("evidence"), (F.startswith("src", F.lit("ex:")) | F.startswith("dst", F.lit("ex:"))).alias("orphan"))
    rows = rows.join(texts, "node_id", "left").withColumn("supported", F.coalesce(expr.evidence_supported(F.col("evidence"), F.col("text"), 0, head), F.lit(False)))
    one = rows.agg(F.count(F.lit(1)).alias("relations"), F.count_if("orphan").alias("orphans"), F.count_if("supported").alias("supported"))
    return one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in one.columns)), F.array(*one.columns))).alias("metric", "n"))


def texts_of(chunks: DataFrame) -> DataFrame:
    """``node_id, text``: the chunks of every node, joined in their order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "")
    return chunks.groupBy("node_id").agg(joined.alias("text"))
