"""Parsers of recorded payloads: XML items, JSON envelopes, wiki pages, infoboxes and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, ontology
from ..operators.graph import closure, degree
from ..operators.store import first_by

ITEM = "ccbaAsno string, ccbaMnm1 string, ccbaMnm2 string, longitude string, latitude string, ccbaCtcdNm string, ccsiName string, content string, ccbaAsdt string, ccceName string"

# Infobox fields with the relation and the types they stand for.
INFOBOX_FIELDS = {
    "지휘관1": ("participated_in", "person"),
    "지휘관2": ("participated_in", "person"),
    "주요인물1": ("participated_in", "person"),
    "주요인물2": ("participated_in", "person"),
    "교전국1": ("participated_in", "org"),
    "교전국2": ("participated_in", "org"),
    "장소": ("occurred_at", "place"),
    "지역": ("occurred_at", "place"),
}
LINK_SKIP = r"^(파일|파일명|이미지|File|Image|틀|Template|분류|Category):"

# Properties of persons with the relation they become, and the type that a target then has by default.
PERSON_PROPERTIES = {"P22": "child_of", "P25": "child_of", "P26": "spouse_of", "P19": "born_in", "P20": "died_in", "P1344": "participated_in", "P39": "held_position", "P463": "member_of", "P170": "created"}
INFERRED = {"born_in": "place", "died_in": "place", "participated_in": "event", "held_position": "org", "member_of": "org"}
CLASS_TYPES = {
    "Q5": "person",
    "Q515": "place",
    "Q486972": "place",
    "Q56061": "place",
    "Q82794": "place",
    "Q3957": "place",
    "Q532": "place",
    "Q6256": "place",
    "Q1549591": "place",
    "Q1190554": "event",
    "Q178561": "event",
    "Q198": "event",
    "Q625298": "event",
    "Q13418847": "event",
    "Q1656682": "event",
    "Q43229": "org",
    "Q7278": "org",
    "Q3024240": "org",
    "Q34770": "org",
    "Q4164871": "role",
    "Q294414": "role",
    "Q216107": "role",
    "Q12737077": "role",
    "Q11424": "media",
    "Q5398426": "media",
    "Q838948": "artwork",
    "Q3305213": "artwork",
}
EVENT_ROOTS = {"Q1190554": "사건", "Q178561": "전투", "Q198": "전쟁", "Q625298": "조약"}


def _map(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def class_type(class_id: Column) -> Column:
    return _map(CLASS_TYPES, class_id)


def xml_items(payloads: DataFrame, schema: str = ITEM) -> DataFrame:
    """Rows of every ``<item>`` in XML payloads (key columns and ``text``); texts are stripped and '' is null."""
    found = payloads.withColumn("_item", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<item>.*?</item>"), F.lit(0))))
    parsed = found.withColumn("_item", F.from_xml("_item", schema))
    names = [f.split()[0] for f in schema.split(", ")]
    return parsed.select(*(c for c in payloads.columns if c != "text"), *(F.nullif(expr.strip(F.col(f"_item.{n}")), F.lit("")).alias(n) for n in names))


def json_items(payloads: DataFrame, schema: str) -> DataFrame:
    """Rows of response.body.items.item, a list or a single object."""
    v = F.try_parse_json("text")
    many = F.try_variant_get(v, "$.response.body.items.item", f"array<{schema}>")
    one = F.try_variant_get(v, "$.response.body.items.item", schema)
    return payloads.select(*(c for c in payloads.columns if c != "text"), F.explode(F.coalesce(many, F.array(one))).alias("item")).where("item is not null").select("*", "item.*").drop("item")


def auth_error(text: Column) -> Column:
    """The reason or message of an error that came as a success, or null."""
    reason = F.nullif(F.regexp_extract(text, r"<returnReasonCode>([^<]*)<", 1), F.lit(""))
    return F.coalesce(reason, F.nullif(F.regexp_extract(text, r"<errMsg>([^<]*)<", 1), F.lit("")))


def heritage(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of heritage items (kdcd, ctcd and ITEM columns): the item, its place and its period."""
    rows = items.where("ccbaAsno is not null and ccbaMnm1 is not null")
    rows = rows.withColumn("id", F.concat(F.lit("khs:"), F.concat_ws("-", "kdcd", "ctcd", "ccbaAsno"))).withColumn("place", F.concat_ws(":", F.lit("kr:place"), "ccbaCtcdNm", "ccsiName")).withColumn("period", F.concat(F.lit("kr:period:"), "ccceName"))
    none = F.lit(None).cast("string")
    item = rows.select("id", F.lit("heritage").alias("type"), F.col("ccbaMnm1").alias("label"), F.col("content").alias("description"), expr.to_double(F.col("latitude")).alias("lat"), expr.to_double(F.col("longitude")).alias("lon"), expr.designated_date(F.col("ccbaAsdt")).alias("designated_on"))
    no = (none.alias("description"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), none.alias("designated_on"))
    places = rows.where("ccbaCtcdNm is not null").select(F.col("place").alias("id"), F.lit("place").alias("type"), F.concat_ws(" ", "ccbaCtcdNm", "ccsiName").alias("label"), *no)
    periods = rows.where("period is not null").select(F.col("period").alias("id"), F.lit("period").alias("type"), F.col("ccceName").alias("label"), *no)
    edges = rows.where("ccbaCtcdNm is not null").select(F.col("id").alias("src"), F.col("place").alias("dst"), F.lit("located_in").alias("type"))
    return item.union(places.union(periods).distinct()), edges.union(rows.where("period is not null").select("id", "period", F.lit("from_period"))).distinct()


def infobox_links(pages: DataFrame) -> DataFrame:
    """``event, field, target`` of pages (event, wikitext): wikilinks in the known fields."""
    part = F.explode(F.split("wikitext", r"(?m)^\s*\|(?=\s*[가-힣A-Za-z0-9_ ]+?\s*=)")).alias("part")
    fields = pages.select("event", part).select("event", expr.strip(F.regexp_extract("part", r"^\s*([가-힣A-Za-z0-9_ ]+?)\s*=", 1)).alias("field"), "part").where(F.col("field").isin(list(INFOBOX_FIELDS)))
    links = fields.select("event", "field", F.explode(F.regexp_extract_all("part", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))).alias("target"))
    return links.withColumn("target", expr.strip(F.col("target"))).where((F.col("target") != "") & ~F.col("target").rlike(LINK_SKIP))


def infobox_edges(links: DataFrame, ids: DataFrame, known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Edges of infobox links whose target (title → qid) has the type that the field wants, in the graph or else as fetched."""
    rows = links.join(ids.select(F.col("title").alias("target"), "qid"), "target").withColumn("id", F.concat(F.lit("wd:"), "qid"))
    rows = rows.join(known.select("id", F.col("type").alias("known")), "id", "left").join(fetched.select("qid", F.col("type").alias("fetched")), "qid", "left")
    rows = rows.where(F.coalesce("known", "fetched") == _map({k: v[1] for k, v in INFOBOX_FIELDS.items()}, F.col("field")))
    kind = _map({k: v[0] for k, v in INFOBOX_FIELDS.items()}, F.col("field"))
    turned = kind == "occurred_at"
    edges = rows.select(F.when(turned, F.col("event")).otherwise(F.col("id")).alias("src"), F.when(turned, F.col("id")).otherwise(F.col("event")).alias("dst"), kind.alias("type"), F.lit("kowiki:infobox").alias("source"), F.lit(0.95).alias("confidence"))
    return edges.distinct()


def requested_titles(wanted: DataFrame, normalized: DataFrame, redirects: DataFrame) -> DataFrame:
    """``title, final``: where normalization and one redirect lead a requested title."""
    a = wanted.join(normalized.select(F.col("from").alias("title"), F.col("to").alias("n")), "title", "left").withColumn("n", F.coalesce("n", "title"))
    return a.join(redirects.select(F.col("from").alias("n"), F.col("to").alias("r")), "n", "left").select("title", F.coalesce("r", "n").alias("final"))


def labels(triples: DataFrame) -> DataFrame:
    """``id, label, class``: the Korean label, else the English one, else the id; of several classes the smallest."""
    of = triples.groupBy(F.col("s").alias("id")).agg(F.expr("min(o) filter (where p = 'label' and lang = 'ko')").alias("ko"), F.expr("min(o) filter (where p = 'label' and lang = 'en')").alias("en"), F.expr("min(o) filter (where p = 'P31')").alias("class"))
    return of.select("id", F.coalesce("ko", "en", "id").alias("label"), "class")


def aliases(triples: DataFrame) -> DataFrame:
    return triples.where("p = 'altLabel' and lang = 'ko'").select(F.concat(F.lit("wd:"), "s").alias("node_id"), F.col("o").alias("alias")).distinct()


def persons(triples: DataFrame, polities: DataFrame) -> DataFrame:
    """``id, polity, start_date, end_date``: humans by the first of the polities (qid, label, seq) they are citizens of."""
    humans = triples.where("p = 'P31' and o = 'Q5'").select("s").distinct()
    of = triples.where("p = 'P27'").join(humans, "s", "left_semi").join(polities.select(F.col("qid").alias("o"), "label", "seq"), "o")
    first = first_by(of, ["s"], [F.col("seq")]).select("s", F.col("label").alias("polity"))
    for p, name in (("P569", "start_date"), ("P570", "end_date")):
        first = first.join(triples.where(F.col("p") == p).groupBy("s").agg(F.min(expr.iso_date(F.col("o"))).alias(name)), "s", "left")
    return first.select(F.concat(F.lit("wd:"), "s").alias("id"), "polity", "start_date", "end_date")


def person_relations(triples: DataFrame, people: DataFrame) -> DataFrame:
    """``src, dst, type, original_type`` of people (id); what the ontology refuses becomes ``related_to``."""
    kind = _map(PERSON_PROPERTIES, F.col("p"))
    rows = triples.where(F.col("p").isin(list(PERSON_PROPERTIES))).select(F.concat(F.lit("wd:"), "s").alias("src"), F.concat(F.lit("wd:"), "o").alias("dst"), F.col("o").alias("id"), kind.alias("type"))
    rows = rows.join(people.select(F.col("id").alias("src")), "src", "left_semi").join(labels(triples).select("id", "class"), "id", "left")
    target = F.coalesce(class_type(F.col("class")), _map(INFERRED, F.col("type")), F.lit("person"))
    rows = rows.withColumn("target", target).join(ontology.edge_rules(triples.sparkSession), "type")
    ok = F.array_contains("from_types", F.lit("person")) & F.array_contains("to_types", F.col("target"))
    return rows.select("src", "dst", F.when(ok, F.col("type")).otherwise("related_to").alias("type"), F.when(~ok, F.col("type")).alias("original_type")).groupBy("src", "dst", "type").agg(F.max("original_type").alias("original_type"))


def media(triples: DataFrame) -> DataFrame:
    """``src, dst, type``: films and series of the country with what they depict."""
    works = triples.where("p = 'P31' and o in ('Q11424', 'Q5398426')").select("s").distinct()
    works = works.join(triples.where("p = 'P495' and o = 'Q884'").select("s"), "s", "left_semi")
    return triples.where("p = 'P921'").join(works, "s", "left_semi").select(F.concat(F.lit("wd:"), "s").alias("src"), F.concat(F.lit("wd:"), "o").alias("dst"), F.lit("depicts").alias("type")).distinct()


def media_nodes(triples: DataFrame) -> DataFrame:
    """``id, type, label, start_date, url`` of works and of what they depict; a subject that is no work is taken for an event."""
    pairs = media(triples)
    works = pairs.select(F.col("src").alias("id")).distinct().withColumn("type", F.lit("media"))
    ids = works.union(pairs.select(F.col("dst").alias("id")).distinct().join(works.select("id"), "id", "left_anti").withColumn("type", F.lit("event")))
    qid = F.regexp_replace("id", "^wd:", "")
    named = ids.withColumn("qid", qid).join(labels(triples).select(F.col("id").alias("qid"), "label"), "qid", "left")
    dated = triples.where("p = 'P577'").groupBy(F.col("s").alias("qid")).agg(F.min(expr.iso_date(F.col("o"))).alias("date"))
    start = F.when(F.col("type") == "media", F.col("date")).alias("start_date")
    return named.join(dated, "qid", "left").select("id", "type", F.coalesce("label", "qid").alias("label"), start, F.concat(F.lit("http://www.wikidata.org/entity/"), "qid").alias("url"))


def bindings(payloads: DataFrame, names: list[str]) -> DataFrame:
    """Rows of SPARQL JSON answers (key columns and ``text``): one column per variable, null where it is unbound.

    Answers that are no JSON, or hold no bindings, give no row.
    """
    kind = f"array<struct<{','.join(f'`{n}`:struct<value:string>' for n in names)}>>"
    rows = F.try_variant_get(F.try_parse_json("text"), "$.results.bindings", kind)
    found = payloads.select(*(c for c in payloads.columns if c != "text"), F.explode(rows).alias("_b"))
    return found.select(*(c for c in found.columns if c != "_b"), *(F.col(f"_b.`{n}`.value").alias(n) for n in names))


def unfetched(wanted: DataFrame, payloads: DataFrame) -> DataFrame:
    """Requests (url, body) whose payload (key, ...) is not stored yet, with the ``key`` they will have."""
    keyed = wanted.withColumn("key", expr.cache_key(F.col("url"), F.col("body"))).dropDuplicates(["key"])
    return keyed.join(payloads.select("key"), "key", "left_anti")


def classified(payloads: DataFrame) -> DataFrame:
    """Payloads with ``error``: why an answer that came as a success is none, or null."""
    return payloads.withColumn("error", auth_error(F.col("text")))


def events(triples: DataFrame, polities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of events: whatever is of an event class, up any number of subclass steps, in one of the polities (qid, label, seq).

    Of several dates or classes the smallest counts. Places become nodes, and edges ``occurred_at``.
    """
    classes = closure(triples.where("p = 'P31'").select(F.col("s").alias("id"), F.col("o").alias("class")), triples.where("p = 'P279'").select(F.col("s").alias("class"), F.col("o").alias("parent")))
    kinds = classes.where(F.col("class").isin(list(EVENT_ROOTS))).groupBy("id").agg(F.min("class").alias("root"))
    near = triples.where("p = 'P17'").join(polities.select(F.col("qid").alias("o")), "o", "left_semi").select(F.col("s").alias("id")).distinct()
    found = kinds.join(near, "id", "left_semi").join(labels(triples).select("id", "label"), "id", "left")
    for p, name in (("P580", "start_date"), ("P582", "end_date")):
        found = found.join(triples.where(F.col("p") == p).groupBy(F.col("s").alias("id")).agg(F.min(expr.iso_date(F.col("o"))).alias(name)), "id", "left")
    nid = F.concat(F.lit("wd:"), F.col("id"))
    nodes = found.select(nid.alias("id"), F.lit("event").alias("type"), F.coalesce("label", "id").alias("label"), "start_date", "end_date", _map(EVENT_ROOTS, F.col("root")).alias("event_class"))
    held = triples.where("p = 'P276'").join(found.select(F.col("id").alias("s")), "s", "left_semi").select("s", "o").distinct()
    places = held.select(F.col("o").alias("id")).distinct().join(labels(triples).select("id", "label"), "id", "left")
    none = F.lit(None).cast("string")
    places = places.select(nid.alias("id"), F.lit("place").alias("type"), F.coalesce("label", "id").alias("label"), none, none, none)
    edges = held.select(F.concat(F.lit("wd:"), "s").alias("src"), F.concat(F.lit("wd:"), "o").alias("dst"), F.lit("occurred_at").alias("type"))
    return nodes.union(places.join(nodes.select("id"), "id", "left_anti")), edges


def extracts(payloads: DataFrame) -> DataFrame:
    """``title, extract`` of the pages of MediaWiki answers (text); pages that are missing or empty are left out."""
    page = "struct<title:string,missing:string,extract:string>"
    pages = F.get_json_object("text", "$.query.pages")  # a list, or in the older format a map by page number
    found = payloads.select(F.explode(F.when(F.startswith(pages, F.lit("[")), F.from_json(pages, f"array<{page}>")).otherwise(F.map_values(F.from_json(pages, f"map<string,{page}>")))).alias("p"))
    found = found.select("p.title", "p.missing", expr.strip(F.col("p.extract")).alias("extract"))
    return found.where("missing is null and extract <> ''").select("title", "extract").distinct()


def titles(rows: DataFrame) -> DataFrame:
    """``qid, title`` of sitelink bindings (item, title, seq): the last title of every item."""
    own = rows.where("item <> '' and title <> ''").groupBy(expr.last_segment(F.col("item")).alias("qid"))
    return own.agg(F.max_by("title", F.struct("seq", "title")).alias("title"))


def first_mapped_class(triples: DataFrame) -> DataFrame:
    """``qid, type``: of the classes that stand for a type, the smallest."""
    own = triples.where("p = 'P31'").withColumn("type", class_type(F.col("o"))).where("type is not null")
    return own.groupBy(F.col("s").alias("qid")).agg(F.min_by("type", "o").alias("type"))


def infobox_nodes(edges: DataFrame, titles: DataFrame, fetched: DataFrame, known: DataFrame) -> DataFrame:
    """``id, type, label`` of the ends of infobox edges that the graph has not yet."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(known.select("id"), "id", "left_anti")
    named = titles.groupBy(F.concat(F.lit("wd:"), "qid").alias("id")).agg(F.min("title").alias("label"))
    return ends.join(named, "id").join(fetched.select(F.concat(F.lit("wd:"), "qid").alias("id"), "type"), "id").select("id", "type", "label")


def to_enrich(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("person", "event"), limit: int = 500, refresh: bool = False, scope: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Nodes of the linked-data source that lack a text, the best connected first; ties go by id."""
    own = nodes.where((F.col("source") == "wd") & F.col("type").isin(*types))
    if not refresh:
        own = own.where(F.length(F.coalesce("description", F.lit(""))) < least)
    if scope is not None:
        own = own.join(scope.select("id"), "id", "left_semi")
    return degree(own, edges).orderBy(F.desc("degree"), "id").limit(limit)


def enrich(nodes: DataFrame, wanted: DataFrame, titles: DataFrame, texts: DataFrame) -> DataFrame:
    """``nodes`` with description and URL from ``texts`` (title, extract) for those ``wanted`` (id) that a title (qid, title) leads to."""
    found = wanted.select("id").join(titles.select(F.concat(F.lit("wd:"), "qid").alias("id"), "title"), "id").join(texts, "title")
    found = found.groupBy("id").agg(F.max(F.struct("title", "extract")).alias("x")).select("id", "x.title", "x.extract")
    url = F.concat(F.lit("https://ko.wikipedia.org/wiki/"), expr.url_title(F.col("title")))
    take = F.col("extract").isNotNull()
    changed = {"description": F.when(take, F.col("extract")).otherwise(F.col("description")), "props": F.when(take, expr.json_set(F.coalesce(F.nullif("props", F.lit("")), F.lit("{}")), "kowiki_url", url)).otherwise(F.col("props"))}
    return nodes.join(found, "id", "left").withColumns(changed).select(*nodes.columns)
