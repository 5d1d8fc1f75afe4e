"""Identity links between sources, the timeline, and reports on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .store import delete_nodes


def link_periods(nodes: DataFrame, source: str = "khs") -> DataFrame:
    """Period labels that name exactly one polity, linked to it if it is a node."""
    named = nodes.where((F.col("type") == "period") & (F.col("source") == source)).select(F.col("id").alias("a"), expr.polities(F.col("label")).alias("p")).where("size(p) = 1")
    links = named.select("a", F.concat(F.lit("wd:"), expr.polity_id(F.col("p")[0])).alias("b"))
    return links.join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", F.lit("period_polity").alias("method"), F.lit(1.0).alias("score"))


def link_places(nodes: DataFrame, source: str = "khs", target: str = "wd") -> DataFrame:
    """Places by exact normalized name, the district first; an ambiguous name falls back to the province."""
    places = nodes.where("type = 'place'")
    known = places.where(F.col("source") == target).groupBy(expr.normalize_place(F.col("label")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("b")).where("n = 1").drop("n")
    own = places.where(F.col("source") == source).select(F.col("id").alias("a"), *(expr.normalize_place(F.nullif(F.get_json_object("props", f"$.{k}"), F.lit(""))).alias(k) for k in ("sigungu", "sido")))
    for k in ("sigungu", "sido"):
        own = own.join(known.select(F.col("name").alias(k), F.col("b").alias(f"{k}_id")), k, "left")
    return own.select("a", F.coalesce("sigungu_id", "sido_id").alias("b"), F.lit("place_label_exact").alias("method"), F.lit(0.9).alias("score")).where("b is not null")


def sports_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("type") == "event") & expr.is_sports(F.col("label"))).select("id")


def bridge_report(nodes: DataFrame, edges: DataFrame, same_as: DataFrame, source: str = "khs") -> DataFrame:
    """``metric, n``: whether identity links join sources, and how many nodes of one source get across by them."""
    a, b = (nodes.select(F.col("id").alias(k), F.col("source").alias(f"{k}_source")) for k in ("a", "b"))
    cross = same_as.join(a, "a").join(b, "b").where("a_source <> b_source").agg(F.count(F.lit(1)).alias("n"))
    reach = edges.join(same_as.select(F.col("a").alias("dst")), "dst").join(nodes.where(F.col("source") == source).select(F.col("id").alias("src")), "src").agg(F.countDistinct("src").alias("n"))
    total = same_as.agg(F.count(F.lit(1)).alias("n"))
    by = same_as.groupBy(F.concat(F.lit("method:"), "method").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    parts = [x.select(F.lit(m).alias("metric"), "n") for m, x in (("total", total), ("cross_source", cross), ("reaching", reach))]
    return parts[0].union(parts[1]).union(parts[2]).union(by)


def year_links(nodes: DataFrame) -> DataFrame:
    """Period labels as the same as their first year."""
    periods = nodes.where("type = 'period'").where(~F.startswith("id", F.lit("time:")))
    year = F.try_element_at(expr.parse_years(F.col("label")), F.lit(1))
    return periods.select(F.col("id").alias("a"), F.concat(F.lit("time:"), year.cast("string")).alias("b"), F.lit("year_from_label").alias("method"), F.lit(0.95).alias("score")).where("b is not null")


def dated_edges(nodes: DataFrame) -> DataFrame:
    """``src, dst, type, source, label`` from the dates of nodes; a year that starts and ends a node keeps the end's label."""
    person = F.col("type") == "person"
    dates = F.array(
        F.struct(F.lit(0).alias("k"), F.when(person, "출생").otherwise("시작").alias("label"), expr.year_of(F.col("start_date")).alias("year")),
        F.struct(F.lit(1).alias("k"), F.when(person, "사망").otherwise("종료").alias("label"), expr.year_of(F.col("end_date")).alias("year")),
    )
    one = nodes.where(~F.startswith("id", F.lit("time:"))).select(F.col("id").alias("src"), F.explode(dates).alias("d")).where("d.year is not null")
    edges = one.groupBy("src", F.col("d.year").alias("year")).agg(F.max_by("d.label", "d.k").alias("label"))
    return edges.select("src", F.concat(F.lit("time:"), F.col("year").cast("string")).alias("dst"), F.lit("dated_to").alias("type"), F.lit("timeline").alias("source"), "label")


def year_nodes(years: DataFrame) -> DataFrame:
    """Nodes of years (year int), once each."""
    y = F.col("year")
    label = F.when(y < 0, F.concat(F.lit("기원전 "), F.abs(y).cast("string"), F.lit("년"))).otherwise(F.concat(y.cast("string"), F.lit("년")))
    start = F.when(y > 0, F.lpad(y.cast("string"), 4, "0")).otherwise(y.cast("string"))
    return years.select("year").distinct().select(F.concat(F.lit("time:"), y.cast("string")).alias("id"), F.lit("period").alias("type"), label.alias("label"), F.lit("timeline").alias("source"), start.alias("start_date"))


def timeline(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and identity links of the timeline, and its report (metric, n).

    Year nodes are made for every year that a label or a date names. The report counts period labels with and without a year,
    dated edges, and the first and last year.
    """
    links, dated = year_links(nodes), dated_edges(nodes)
    year = F.substring_index(F.col("id"), ":", -1).cast("int").alias("year")
    years = year_nodes(links.select(F.col("b").alias("id")).union(dated.select(F.col("dst").alias("id"))).select(year))
    periods = nodes.where("type = 'period'").where(~F.startswith("id", F.lit("time:")))
    labels = periods.select(F.explode(F.array(F.lit("labels_linked"), F.lit("labels_unparsed"))).alias("metric"), (F.size(expr.parse_years(F.col("label"))) > 0).alias("has"))
    labels = labels.groupBy("metric").agg(F.sum(((F.col("metric") == "labels_linked") == F.col("has")).cast("long")).alias("n"))
    span = years.select(year).agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"), F.count(F.lit(1)).alias("years"))
    span = span.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in span.columns)), F.array(*(F.col(c).cast("long") for c in span.columns)))).alias("metric", "n"))
    report = labels.union(span).union(dated.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dated"), "n"))
    return years, dated, links, report


def prune(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes ``gone`` (id), and how many nodes and edges went (metric, n)."""
    kept = delete_nodes(nodes, edges, aliases, gone)
    lost = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n") for name, x in (("nodes", nodes.join(gone.select("id"), "id", "left_semi")), ("edges", edges.join(_ends_in(edges, gone), ["src", "dst", "type", "source"], "left_semi")))]
    return *kept, lost[0].union(lost[1])


def _ends_in(edges: DataFrame, gone: DataFrame) -> DataFrame:
    key = edges.select("src", "dst", "type", "source")
    return key.join(gone.select(F.col("id").alias("src")), "src", "left_semi").unionByName(key.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()


def whats_in(nodes: DataFrame, edges: DataFrame, same_as: DataFrame, year: int, limit: int = 20) -> DataFrame:
    """What is dated to a year or is the same as it, in a fixed order."""
    own = f"time:{year}"
    dated = edges.where((F.col("dst") == own) & (F.col("type") == "dated_to")).select(F.col("src").alias("id"), F.col("label").alias("rel"), F.lit("dated_to").alias("via"))
    same = same_as.where(F.col("b") == own).select(F.col("a").alias("id"), F.col("method").alias("rel"), F.lit("same_as").alias("via"))
    return dated.union(same).join(nodes.select("id", "label", "type"), "id").select("label", "type", "rel", "via").distinct().orderBy("type", "label", "rel", "via").limit(limit)
