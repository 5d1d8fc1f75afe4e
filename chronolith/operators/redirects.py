"""Redirects of any length, what requested titles lead to, and events seeded by title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .lineage import cut


def followed(links: DataFrame) -> DataFrame:
    """``title, final, steps``: where the redirects (from, to) of every title end, and after how many; both null if that is never.

    Pointers jump: each round doubles the steps that a row stands for, so chains of n steps take log n rounds. When a
    round settles nothing, what is left leads into a cycle: on a longer chain there would be titles half as far. Of several targets of a title
    the smallest counts.
    """
    first = links.where("from is not null and to is not null").groupBy(F.col("from").alias("title")).agg(F.min("to").alias("at"))
    ends = first.select(F.col("title").alias("at")).withColumn("goes_on", F.lit(True))
    state = cut(first.join(ends, "at", "left").select("title", "at", F.lit(1).cast("long").alias("steps"), F.coalesce("goes_on", F.lit(False)).alias("open")))
    left = state.where("open").count()
    while left:
        ahead = state.select(F.col("title").alias("at"), F.col("at").alias("then"), F.col("steps").alias("more"), F.col("open").alias("still"))
        jumped = state.where("open").join(ahead, "at").select("title", F.col("then").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        state = cut(state.where("not open").unionByName(jumped))
        now = state.where("open").count()
        if now == left:
            break
        left = now
    return state.select("title", F.when(~F.col("open"), F.col("at")).alias("final"), F.when(~F.col("open"), F.col("steps")).alias("steps"))


def requested(wanted: DataFrame, normalized: DataFrame, redirects: DataFrame) -> DataFrame:
    """``title, final``: where normalization and then redirects lead every wanted title; null in a cycle."""
    a = wanted.select("title").distinct().join(normalized.groupBy(F.col("from").alias("title")).agg(F.min("to").alias("n")), "title", "left")
    a = a.select("title", F.coalesce("n", "title").alias("n"))
    b = followed(redirects).select(F.col("title").alias("n"), "final", F.lit(True).alias("moved"))
    return a.join(b, "n", "left").select("title", F.when(F.col("moved"), F.col("final")).otherwise(F.col("n")).alias("final"))


def articles(wanted: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is found (requested, qid, extract, title) and what is missing (requested) of wanted titles.

    A page (title, qid, extract) without an item or a text is missing too.
    """
    whole = pages.select("title", "qid", expr.strip(F.col("extract")).alias("extract")).where("qid <> '' and extract <> ''").dropDuplicates(["title"])
    led = requested(wanted, normalized, redirects).select(F.col("title").alias("requested"), F.col("final").alias("title")).join(whole, "title", "left")
    return led.where("qid is not null").select("requested", "qid", "extract", "title"), led.where("qid is null").select("requested")


def seeded_events(seeds: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the articles that seeds (era, title, seq) led to.

    A title that stands under several eras belongs to the last; of titles that lead to one item the last one counts for the node.
    An era that is a polity gives an edge to its node, which is made unless an event has its id; no edge leads to itself.
    """
    era = seeds.groupBy(F.col("title").alias("requested")).agg(F.max_by("era", "seq").alias("era"), F.min("seq").alias("seq"))
    rows = found.join(era, "requested").withColumns({"id": F.concat(F.lit("wd:"), "qid"), "polity": F.concat(F.lit("wd:"), expr.polity_id(F.col("era")))})
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "extract", "era", "qid"), F.struct("seq", "requested")).alias("x")).select("id", "x.*")
    props = F.to_json(F.struct(F.concat(F.lit("https://ko.wikipedia.org/wiki/"), expr.url_title(F.col("title"))).alias("kowiki_url"), F.col("era").alias("seed_era"), F.lit(True).alias("seeded")))
    events = last.select("id", F.lit("event").alias("type"), F.col("title").alias("label"), F.lit("wd").alias("source"), F.col("extract").alias("description"), F.concat(F.lit("https://www.wikidata.org/entity/"), "qid").alias("url"), props.alias("props"))
    dated = rows.where("polity is not null and polity <> id")
    none = F.lit(None).cast("string")
    polities = dated.groupBy("polity").agg(F.min_by("era", "seq").alias("era")).select(F.col("polity").alias("id"), F.lit("org").alias("type"), F.col("era").alias("label"), F.lit("wd").alias("source"), none.alias("description"), none.alias("url"), F.lit("{}").alias("props"))
    edges = dated.select(F.col("id").alias("src"), F.col("polity").alias("dst"), F.lit("from_period").alias("type"), F.lit("kowiki").alias("source")).distinct()
    return events.unionByName(polities.join(events.select("id"), "id", "left_anti")), edges
