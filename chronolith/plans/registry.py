"""All queries of the library itself, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, ontology
from ..operators import documents, extraction, graph, resolve, store
from ..operators.lineage import cut, shared_path
from ..sources import payloads, persist
from ..sources.graphstore import GraphStore
from ..streaming import ingest
from . import fixtures as X
from .view import copies, copies_sql, edges, literal, nodes, read, same_as, spread, spread_sql, sql, values

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Marks of a Latin-script corpus, in place of the Korean defaults, for queries over ``documents``.
LATIN = (r"\b(?:idiot|clown|moron|loser)\b", r"\b(?:license|version|licensed)\b", r"\d{4}")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def lit(spark: SparkSession, fixture: tuple) -> DataFrame:
    return literal(spark, *fixture)


#: Entities that every copy of the small graph has for itself, as nodes and in triples; polities and classes are shared.
OWN_NODES = tuple(r[0] for r in X.NODES[0] if r[0] != "wd:Q28179") + ("wd:Q999",)
OWN_QIDS = tuple(f"Q{k}" for k in (9, 10, 11, 50, 60, 70, 80, 81, 90, 91, 92, 93, 94, 95, 96, 37682))
_FILL = "replace(replace(props, '\":\"', '\":\"' || _k), '\":\"' || _k || '조선', '\":\"조선')"


def fixture_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The small graph's nodes for every supplier: its places have names of their own, its events texts of many lengths."""
    n = copies(spark, d, X.NODES, OWN_NODES)
    k, place = F.col("_k"), F.col("type") == "place"
    mark = F.concat(F.lit('":"'), k)
    props = F.replace(F.replace("props", F.lit('":"'), mark), F.concat(mark, F.lit("조선")), F.lit('":"조선'))
    n = n.withColumns({"label": F.when(place & (F.col("source") == "wd"), F.concat(k, "label")).otherwise(F.col("label")), "props": props, "description": F.when(F.col("type") == "event", F.repeat(F.lit("."), (k.cast("int") * 997 + F.length("label") * 13) % 8000)).otherwise(F.col("description"))})
    return n.drop("_k").distinct()


def fixture(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A small table for every supplier."""
    rows, own = {"EDGES": (X.EDGES, OWN_NODES), "ALIASES": (X.ALIASES, OWN_NODES), "RELATIONS": (X.RELATIONS, OWN_NODES), "TRIPLES": (X.TRIPLES, OWN_QIDS)}[name]
    return lambda s, d: copies(s, d, rows, own).drop("_k").distinct()


triples, small_edges, small_aliases, small_relations = (fixture(n) for n in ("TRIPLES", "EDGES", "ALIASES", "RELATIONS"))


# --- the graph itself -------------------------------------------------------------------------

query("node_union", sql("SELECT id, type, label, source, start_date, props FROM nodes"))(lambda s, d: nodes(s, d).select("id", "type", "label", "source", "start_date", "props"))
query("edge_union", sql("SELECT src, dst, type, source, label FROM edges"))(lambda s, d: edges(s, d).select("src", "dst", "type", "source", "label"))
query("stats_node_type", sql("SELECT type, count(*) AS n FROM nodes GROUP BY type"))(lambda s, d: store.counts(nodes(s, d), "type"))
query("stats_edge_type", sql("SELECT type, count(*) AS n FROM edges GROUP BY type"))(lambda s, d: store.counts(edges(s, d), "type"))
query("stats_source", sql("SELECT source, count(*) AS n FROM nodes GROUP BY source"))(lambda s, d: store.counts(nodes(s, d), "source"))


@query("dangling_edges", sql("SELECT src, dst, type, source FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.src AND NOT (type = 'artwork' AND substr(id, 3)::BIGINT % 97 = 0)) OR NOT EXISTS (SELECT 1 FROM nodes WHERE id = e.dst AND NOT (type = 'artwork' AND substr(id, 3)::BIGINT % 97 = 0))"))
def _dangling(s: SparkSession, d: str) -> DataFrame:
    known = nodes(s, d).where("not (type = 'artwork' and cast(substr(id, 3) as bigint) % 97 = 0)")
    return store.dangling(edges(s, d), known).select("src", "dst", "type", "source")


query("degree", sql("SELECT n.id, coalesce(k, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS k FROM inc GROUP BY id) USING (id)"))(lambda s, d: graph.degree(nodes(s, d), edges(s, d)).select("id", "degree"))
query("gazetteer_topn", sql("SELECT type, rank::INTEGER AS rank, label FROM (SELECT n.type, n.label, row_number() OVER (PARTITION BY n.type ORDER BY coalesce(k, 0) DESC, length(n.label), n.id) AS rank FROM nodes n LEFT JOIN (SELECT id, count(*) AS k FROM inc GROUP BY id) USING (id) WHERE n.type IN ('person', 'event', 'place', 'period') AND length(n.label) >= 2) WHERE rank <= 150"))(
    lambda s, d: graph.gazetteer(nodes(s, d), edges(s, d))
)

_NEAR = """, l0 AS (SELECT '{start}' AS id), l1 AS (SELECT DISTINCT other AS id FROM {links} WHERE id IN (SELECT id FROM l0) EXCEPT SELECT id FROM l0),
 l2 AS (SELECT DISTINCT other AS id FROM {links} WHERE id IN (SELECT id FROM l1) EXCEPT (SELECT id FROM l0 UNION SELECT id FROM l1)),
 seen AS (SELECT id FROM l0 UNION SELECT id FROM l1 {more})
SELECT 'node' AS kind, id AS a, '' AS b, type FROM nodes WHERE id IN (SELECT id FROM seen)
UNION ALL SELECT DISTINCT 'edge', src, dst, type FROM edges WHERE src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen) AND (src IN (SELECT id FROM l0 {walked}) OR dst IN (SELECT id FROM l0 {walked}))
UNION ALL SELECT 'same', a, b, method FROM same_as WHERE {same} AND a IN (SELECT id FROM seen) AND b IN (SELECT id FROM seen) AND (a IN (SELECT id FROM l0 {walked}) OR b IN (SELECT id FROM l0 {walked}))"""


def _near_sql(start: str, depth: int, same: bool) -> str:
    two = depth == 2
    return sql(_NEAR.format(start=start, links="links" if same else "inc", more="UNION SELECT id FROM l2" if two else "", walked="UNION SELECT id FROM l1" if two else "", same="true" if same else "false"))


def _flat(g: graph.Subgraph) -> DataFrame:
    out = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "type")
    return out.union(g.edges.select(F.lit("edge"), "src", "dst", "type")).union(g.same_as.select(F.lit("same"), "a", "b", "method"))


query("neighbors_d1", _near_sql("c:1", 1, True))(lambda s, d: _flat(graph.neighbors(nodes(s, d), cut(edges(s, d)), same_as(s, d), "c:1", 1)))
query("neighbors_d2", _near_sql("c:1", 2, True))(lambda s, d: _flat(graph.neighbors(nodes(s, d), cut(edges(s, d)), same_as(s, d), "c:1", 2, max_nodes=1_000_000)))
query("neighbors_same_as", _near_sql("n:3", 1, True))(lambda s, d: _flat(graph.neighbors(nodes(s, d), cut(edges(s, d)), same_as(s, d), "n:3", 1, max_nodes=1_000_000)))
query("neighbors_no_same_as", _near_sql("n:3", 1, False))(lambda s, d: _flat(graph.neighbors(nodes(s, d), cut(edges(s, d)), same_as(s, d), "n:3", 1, max_nodes=1_000_000, follow_same_as=False)))
query("neighbors_truncated", sql("SELECT id, type FROM nodes WHERE id = 'n:3' OR id IN (SELECT DISTINCT other FROM links WHERE id = 'n:3' ORDER BY other LIMIT 9)"))(lambda s, d: graph.neighbors(nodes(s, d), cut(edges(s, d)), same_as(s, d), "n:3", 2, max_nodes=10).nodes.select("id", "type"))

_SEEDS = "seeds AS MATERIALIZED (SELECT id FROM nodes WHERE type IN ('person', 'event') AND props LIKE '%\"BUILDING\"%' UNION SELECT src FROM edges WHERE type = 'from_period' AND (dst = 's:1' OR dst IN (SELECT a FROM same_as WHERE b = 's:1')))"
_ALL = f", near AS MATERIALIZED (SELECT id, other FROM links), {_SEEDS}, wide AS MATERIALIZED (SELECT id FROM seeds UNION SELECT other FROM near WHERE id IN (SELECT id FROM seeds)), keep AS (SELECT id FROM wide UNION SELECT 's:1'), kept AS MATERIALIZED (SELECT id FROM keep WHERE id IN (SELECT id FROM near))"


def _scope(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The era's subgraph; the view's edges are stored once, as a graph's are."""
    return graph.scope(nodes(s, d), cut(edges(s, d)), same_as(s, d), "BUILDING", "s:1")


def _expanded(s: SparkSession, d: str) -> DataFrame:
    own = cut(edges(s, d))
    return graph.expand(graph.era_seeds(nodes(s, d), own, same_as(s, d), "BUILDING", "s:1"), own, same_as(s, d))


query("era_seeds", sql(f", {_SEEDS} SELECT id FROM seeds"))(lambda s, d: graph.era_seeds(nodes(s, d), edges(s, d), same_as(s, d), "BUILDING", "s:1"))
query("expand_1hop", sql(f"{_ALL} SELECT id FROM wide"))(lambda s, d: _expanded(s, d))
query("scope_nodes", sql(f"{_ALL} SELECT id, type FROM nodes WHERE id IN (SELECT id FROM kept)"))(lambda s, d: _scope(s, d)[0].select("id", "type"))
query("scope_edges", sql(f"{_ALL} SELECT src, dst, type, source FROM edges JOIN (SELECT id AS src FROM kept) USING (src) JOIN (SELECT id AS dst FROM kept) USING (dst)"))(lambda s, d: _scope(s, d)[1].select("src", "dst", "type", "source"))
query("isolated", sql("SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM links)"))(lambda s, d: graph.isolated(nodes(s, d).select("id"), edges(s, d), same_as(s, d)))

_T = f"t AS (SELECT DISTINCT s, p, o, lang FROM {copies_sql(X.TRIPLES, OWN_QIDS)})"
query("class_closure", f"WITH RECURSIVE {_T}, c AS (SELECT s AS id, o AS class FROM t WHERE p = 'P31' UNION SELECT c.id, t.o FROM c JOIN t ON t.s = c.class AND t.p = 'P279') SELECT id, class FROM c")(
    lambda s, d: graph.closure(*(triples(s, d).where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b)) for p, a, b in (("P31", "id", "class"), ("P279", "class", "parent"))))
)

# --- merging ----------------------------------------------------------------------------------

_UPSERT = "SELECT id, type, CASE WHEN k % 3 = 0 THEN label || '*' ELSE label END AS label, source, CASE WHEN k % 3 = 0 THEN coalesce(start_date, '2000') ELSE start_date END AS start_date, CASE WHEN k % 3 = 0 THEN '{\"v\":2}' ELSE props END AS props FROM (SELECT *, substr(id, 3)::BIGINT AS k FROM nodes)"


@query("upsert_nodes", sql(_UPSERT))
def _upsert_nodes(s: SparkSession, d: str) -> DataFrame:
    """Every third node comes again twice: first with a description and a date, then with a new label and props only."""
    old = nodes(s, d)
    again = old.where("cast(substr(id, 3) as bigint) % 3 = 0").withColumn("source", F.lit("new")).withColumn("type", F.lit("role"))
    first = again.withColumn("start_date", F.coalesce("start_date", F.lit("2000"))).withColumn("seq", F.lit(0))
    second = again.withColumn("start_date", F.lit(None).cast("string")).withColumn("label", F.concat("label", F.lit("*"))).withColumn("props", F.lit('{"v":2}')).withColumn("seq", F.lit(1))
    return store.upsert_nodes(old, first.unionByName(second)).select("id", "type", "label", "source", "start_date", "props")


@query("upsert_edges", sql("SELECT src, dst, type, source, CASE WHEN type = 'born_in' THEN 'again' ELSE label END AS label, CASE WHEN type = 'born_in' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM edges"))
def _upsert_edges(s: SparkSession, d: str) -> DataFrame:
    new = edges(s, d).where("type = 'born_in'").withColumn("label", F.lit("again")).withColumn("confidence", F.lit(0.5)).withColumn("seq", F.lit(0))
    return store.upsert_edges(edges(s, d), new).select("src", "dst", "type", "source", "label", "confidence")


@query("aliases_insert_ignore", sql("SELECT DISTINCT 'n:' || n_nationkey AS node_id, alias FROM nation, (VALUES ('one'), ('two')) AS v(alias)"))
def _aliases(s: SparkSession, d: str) -> DataFrame:
    own = nodes(s, d).where("source = 'nat'").withColumn("aliases", F.array(F.lit("one"), F.lit(""), F.col("label"), F.lit("two"), F.lit("one")))
    old = own.where("cast(substr(id, 3) as int) < 5").select(F.col("id").alias("node_id"), F.lit("one").alias("alias"))
    return store.insert_aliases(old, own)


@query("same_as_replace", sql("SELECT a, b, CASE WHEN substr(a, 3)::INTEGER % 2 = 0 THEN 'hand' ELSE method END AS method, CASE WHEN substr(a, 3)::INTEGER % 2 = 0 THEN 1.0 ELSE score END::DOUBLE AS score FROM same_as"))
def _same_as(s: SparkSession, d: str) -> DataFrame:
    old = same_as(s, d)
    return store.replace_same_as(old, old.where("cast(substr(a, 3) as int) % 2 = 0").withColumn("method", F.lit("hand")).withColumn("score", F.lit(1.0)).withColumn("seq", F.lit(0)))


@query("prune_by_label", sql("SELECT src, dst, type, source FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE type = 'event' AND substr(id, 3)::BIGINT % 7 = 0) AND dst NOT IN (SELECT id FROM nodes WHERE type = 'event' AND substr(id, 3)::BIGINT % 7 = 0)"))
def _prune(s: SparkSession, d: str) -> DataFrame:
    """Every seventh event, and every place, has the label of a sports event; only the events go."""
    n = nodes(s, d).withColumn("label", F.when((F.col("type") == "place") | (F.substr("id", F.lit(3)).cast("long") % 7 == 0), "Season 12").otherwise(F.col("label")))
    none = s.createDataFrame([], "node_id string, alias string")
    return store.delete_nodes(n, edges(s, d), none, resolve.sports_by_label(n))[1].select("src", "dst", "type", "source")


@query("prune_by_class", f"WITH RECURSIVE {_T}, c AS (SELECT s AS id, o AS class FROM t WHERE p = 'P31' UNION SELECT c.id, t.o FROM c JOIN t ON t.s = c.class AND t.p = 'P279') SELECT DISTINCT s AS id FROM t WHERE p = 'P31' AND s NOT IN (SELECT id FROM c WHERE class IN ('Q13406554', 'Q16510064', 'Q46190676', 'Q500834'))")
def _prune_class(s: SparkSession, d: str) -> DataFrame:
    own = triples(s, d).where("p = 'P31'").select(F.col("s").alias("id")).distinct()
    gone = _QUERIES["class_closure"](s, d).where("class in ('Q13406554', 'Q16510064', 'Q46190676', 'Q500834')").select("id").distinct()
    none = s.createDataFrame([], "node_id string, alias string")
    return store.delete_nodes(own, s.createDataFrame([], "src string, dst string"), none, gone)[0]


query("store_stats", sql("SELECT 'nodes' AS metric, '' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'same_as', '', count(*) FROM same_as UNION ALL SELECT 'node_type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM nodes GROUP BY source UNION ALL SELECT 'dangling', '', count(*) FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)"))(
    lambda s, d: store.stats(nodes(s, d), edges(s, d), same_as(s, d))
)

# --- the store ---------------------------------------------------------------------------------


def new_store(s: SparkSession, buckets: int = 16) -> GraphStore:
    """A store of its own in the folder that the cluster shares."""
    return GraphStore(s, shared_path(s, "store"), buckets)


@query("store_merge", sql(_UPSERT))
def _store_merge(s: SparkSession, d: str) -> DataFrame:
    """The batches of ``upsert_nodes``, the later one appended first, folded bucket by bucket."""
    store_, old = new_store(s), nodes(s, d)
    again = old.where("cast(substr(id, 3) as bigint) % 3 = 0").withColumn("source", F.lit("new")).withColumn("type", F.lit("role"))
    first = again.withColumn("start_date", F.coalesce("start_date", F.lit("2000")))
    second = again.withColumn("start_date", F.lit(None).cast("string")).withColumn("label", F.concat("label", F.lit("*"))).withColumn("props", F.lit('{"v":2}'))
    tx = store_.begin()
    tx.append("nodes", second, F.lit(3))
    tx.append("nodes", old, F.lit(1))
    tx.compact("nodes")
    tx.merge("nodes", first, F.lit(2))
    tx.merge("nodes", second, F.lit(3))
    tx.commit()
    return store_.read("nodes").select("id", "type", "label", "source", "start_date", "props")


@query("store_small_batch", sql("SELECT 'rows' AS metric, count(*) AS n FROM nodes UNION ALL SELECT 'changed', count(*) FROM nodes WHERE id = (SELECT min(id) FROM nodes WHERE type = 'event') UNION ALL SELECT 'buckets_rewritten', 1 UNION ALL SELECT 'rows_before', count(*) FROM nodes WHERE label = 'changed'"))
def _store_small(s: SparkSession, d: str) -> DataFrame:
    """A batch of one key rewrites one bucket; the version before it can still be read."""
    store_ = new_store(s)
    tx = store_.begin()
    tx.merge("nodes", nodes(s, d))
    before = tx.commit()
    tx = store_.begin()
    one = nodes(s, d).where("type = 'event'").agg(F.min("id").alias("id"))
    tx.merge("nodes", one.withColumn("label", F.lit("changed")).withColumn("type", F.lit("event")).withColumn("source", F.lit("x")))
    after = tx.commit()
    rewritten = sum(after.tables["nodes"][b] != segments for b, segments in before.tables["nodes"].items())
    now, then = store_.read("nodes"), store_.read("nodes", before.version)
    parts = [now.agg(F.lit("rows").alias("metric"), F.count(F.lit(1)).alias("n")), now.where("label = 'changed'").agg(F.lit("changed"), F.count(F.lit(1))), s.range(1).select(F.lit("buckets_rewritten"), F.lit(rewritten).cast("long")), then.where("label = 'changed'").agg(F.lit("rows_before"), F.count(F.lit(1)))]
    return reduce(DataFrame.union, parts)


@query("store_delete", sql("SELECT src, dst, type, source FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE type = 'event' AND substr(id, 3)::BIGINT % 7 = 0) AND dst NOT IN (SELECT id FROM nodes WHERE type = 'event' AND substr(id, 3)::BIGINT % 7 = 0)"))
def _store_delete(s: SparkSession, d: str) -> DataFrame:
    """Every seventh event goes with its edges."""
    store_ = new_store(s)
    tx = store_.begin()
    for name, rows in (("nodes", nodes(s, d)), ("edges", edges(s, d)), ("aliases", nodes(s, d).select(F.col("id").alias("node_id"), F.col("label").alias("alias")))):
        tx.merge(name, rows)
    tx.commit()
    tx = store_.begin()
    tx.delete_nodes(nodes(s, d).where("type = 'event' and cast(substr(id, 3) as bigint) % 7 = 0"))
    tx.commit()
    return store_.read("edges").select("src", "dst", "type", "source")


query("store_scope", sql(f"{_ALL}, n AS (SELECT id, type, source FROM nodes WHERE id IN (SELECT id FROM kept)), e AS (SELECT src, dst, edges.type, edges.source FROM edges JOIN (SELECT id AS src FROM kept) USING (src) JOIN (SELECT id AS dst FROM kept) USING (dst)) SELECT 'nodes' AS metric, '' AS key, count(*) AS n FROM n UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'same_as', '', count(*) FROM same_as WHERE a IN (SELECT id FROM kept) AND b IN (SELECT id FROM kept) UNION ALL SELECT 'node_type', type, count(*) FROM n GROUP BY type UNION ALL SELECT 'edge_type', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM n GROUP BY source UNION ALL SELECT 'dangling', '', count(*) FROM e WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)"))(
    lambda s, d: persist.save_scope(_stored(s, d), new_store(s), "BUILDING", "s:1")[1]
)


def _stored(s: SparkSession, d: str) -> GraphStore:
    """The view as a store."""
    store_ = new_store(s)
    tx = store_.begin()
    for name, rows in (("nodes", nodes(s, d)), ("edges", edges(s, d)), ("same_as", same_as(s, d))):
        tx.merge(name, rows)
    tx.commit()
    return store_


@query("persist_report", sql("SELECT 'nodes' AS metric, '' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'problem', CASE type WHEN 'occurred_at' THEN 'created: src event' ELSE 'participated_in: dst place' END, count(*) FROM edges WHERE type IN ('occurred_at', 'born_in') GROUP BY type UNION ALL SELECT 'stored', '', count(*) FROM edges UNION ALL SELECT 'logged', 'view', count(*) FROM edges"))
def _persist(s: SparkSession, d: str) -> DataFrame:
    """Two edge types misnamed: what the pass that stores them tells, and what is stored."""
    store_ = new_store(s)
    wrong = edges(s, d).withColumn("type", F.when(F.col("type") == "occurred_at", "created").when(F.col("type") == "born_in", "participated_in").otherwise(F.col("type")))
    r = persist.persist(store_, "view", nodes(s, d), wrong, datetime(2024, 1, 1))
    told = [("nodes", "", r.nodes), ("edges", "", r.edges), *(("problem", k, n) for k, n in r.named)]
    stored = store_.read("edges").agg(F.lit("stored").alias("metric"), F.lit("").alias("key"), F.count(F.lit(1)).alias("n"))
    return literal(s, told, "metric string, key string, n long").union(stored).union(store_.read("ingest_log").select(F.lit("logged"), "source", "edges"))


@query("stream_events", "WITH e AS (SELECT DISTINCT ON (event_id) * FROM events) SELECT 'u:' || user_id AS id, 'person' AS type, arg_max(event_type, epoch_us(ts)) AS label, arg_max(strftime(ts, '%Y-%m-%d'), epoch_us(ts)) AS start_date, arg_max(strftime(ts, '%Y-%m-%d'), epoch_us(ts)) FILTER (WHERE value > 20) AS end_date FROM e GROUP BY user_id")
def _stream_events(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream: in four batches out of their order, one of them twice, each user's newest kind and dates."""
    where, store_ = shared_path(s, "stream"), new_store(s)
    events = read(s, d, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    for k in (2, 0, 3, 1, 0):
        events.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = s.readStream.schema(events.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = ingest.deduplicated(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", ["event_id"], "36500 days").select(
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), F.lit("person").alias("type"), F.col("event_type").alias("label"), F.lit("events").alias("source"), day.alias("start_date"), F.when(F.col("value") > 20, day).alias("end_date"), F.unix_micros("at").alias("at")
    )
    ingest.stream_into(rows, store_, "nodes", "events", F.col("at"), f"{where}/checkpoint", compact=3).awaitTermination()
    return store_.read("nodes").select("id", "type", "label", "start_date", "end_date")


# --- checks -----------------------------------------------------------------------------------

query("validate_nodes", sql("SELECT violation, count(*) AS n FROM (SELECT CASE WHEN id LIKE 's:%' THEN 'type' WHEN id LIKE 'r:%' THEN 'id' WHEN id LIKE 'n:%' THEN 'label' END AS violation FROM nodes) GROUP BY violation"))(
    lambda s, d: nodes(s, d).select(ontology.node_violation(F.when(F.startswith("id", F.lit("s:")), "bad").otherwise(F.col("type")), F.when(F.startswith("id", F.lit("r:")), "bad").otherwise(F.col("id")), F.when(F.startswith("id", F.lit("n:")), "").otherwise(F.col("label"))).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
)
query("validate_edges", sql("SELECT src, dst, 'created' AS type, 'src' AS problem FROM edges WHERE type = 'occurred_at' UNION ALL SELECT src, dst, 'participated_in', 'dst' FROM edges WHERE type = 'born_in'"))(
    lambda s, d: ontology.endpoint_problems(edges(s, d).withColumn("type", F.when(F.col("type") == "occurred_at", "created").when(F.col("type") == "born_in", "participated_in").otherwise(F.col("type"))), nodes(s, d)).select("src", "dst", "type", "problem")
)
query("orient_edges", sql("SELECT src, dst, type, true AS flipped FROM (SELECT dst AS src, src AS dst, type FROM edges WHERE type IN ('participated_in', 'created')) UNION ALL SELECT src, dst, type, false FROM edges WHERE type NOT IN ('participated_in', 'created')"))(
    lambda s, d: ontology.oriented(ontology.with_end_types(edges(s, d).withColumns({k: F.when(F.col("type").isin("participated_in", "created"), F.col(v)).otherwise(F.col(k)) for k, v in (("src", "dst"), ("dst", "src"))}), nodes(s, d))).select("src", "dst", "type", "flipped")
)

# --- scalar functions over literals -----------------------------------------------------------

_HANGUL_END = r"(?:[^\p{L}\p{N}_]|$)"
_HANGUL_START = r"(?:^|[^\p{L}\p{N}_])"


def _re2(pattern: str) -> str:
    """Word borders that know letters of every script, for RE2."""
    out = pattern.replace(r"\b(?:doubles|singles)\b", f"{_HANGUL_START}(?:doubles|singles){_HANGUL_END}").replace(r"\bGames\b", f"{_HANGUL_START}Games{_HANGUL_END}").replace(r"\bCup\b", f"{_HANGUL_START}Cup{_HANGUL_END}")
    return out.replace(r"\b", _HANGUL_END).replace("'", "''")


_YEAR = ("1988", "year(o_orderdate)", "year(o_orderdate)")
_1392 = ("1392", "year(o_orderdate)", "year(o_orderdate)")


def _labels(s: SparkSession, d: str, fixture_: tuple) -> DataFrame:
    """Labels with a number before them, one for every part."""
    return spread(s, d, fixture_, "part", "p_partkey").withColumn("label", F.concat(F.lit("N"), F.col("_k").cast("string"), F.lit(" "), "label"))


def _labels_sql(fixture_: tuple) -> str:
    return f"(SELECT 'N' || _k || ' ' || label AS label FROM {spread_sql(fixture_, 'part', 'p_partkey')})"


query("is_sports", f"SELECT label, class, coalesce(class IN ({', '.join(repr(c) for c in expr.SPORTS_CLASSES)}), false) OR coalesce(regexp_matches(label, '(?i)(?:{_re2(expr.SPORTS_WORDS)})'), false) AS sports FROM {spread_sql(X.SPORTS, 'orders', 'o_orderkey', (_YEAR,))}")(
    lambda s, d: spread(s, d, X.SPORTS, "orders", "o_orderkey", (_YEAR,)).drop("_k").withColumn("sports", expr.is_sports(F.col("label"), F.col("class")))
)
_SUFFIX = expr.ADMIN_SUFFIX
_PLACE_SQL = f"CASE WHEN regexp_replace({{0}}, '{_SUFFIX}', '') = '' THEN {{0}} ELSE regexp_replace({{0}}, '{_SUFFIX}', '') END"
query("normalize_place", f"SELECT label, {_PLACE_SQL.format('trim(label)')} AS name FROM {_labels_sql(X.PLACES)}")(lambda s, d: _labels(s, d, X.PLACES).drop("_k").withColumn("name", expr.normalize_place(F.col("label"))))
query("normalize_period", f"SELECT label, regexp_replace(trim(label), '\\s*시대$', '') AS name FROM {_labels_sql(X.PERIODS)}")(lambda s, d: _labels(s, d, X.PERIODS).drop("_k").withColumn("name", expr.normalize_period(F.col("label"))))
_POL = "통일신라|대한제국|고구려|고려|발해|백제|신라|조선"
_POL_SQL = f"(SELECT label, CASE WHEN list_contains(p, '통일신라') THEN list_filter(p, lambda x: x <> '신라') ELSE p END AS p FROM (SELECT label, list_filter(a, lambda x, i: list_position(a, x) = i) AS p FROM (SELECT label, regexp_extract_all(label, '{_POL}') AS a FROM {_labels_sql(X.PERIODS)})))"
query("extract_polities", f"SELECT label, array_to_string(p, ',') AS polities FROM {_POL_SQL}")(lambda s, d: _labels(s, d, X.PERIODS).drop("_k").withColumn("polities", F.array_join(expr.polities(F.col("label")), ",")))
_YEARS_SQL = "CASE WHEN regexp_extract({0}, '(?:기원전|서기전|B\\.?C\\.?)\\s*(\\d{{1,4}})', 1) <> '' THEN [-regexp_extract({0}, '(?:기원전|서기전|B\\.?C\\.?)\\s*(\\d{{1,4}})', 1)::INTEGER] ELSE list_filter(list_transform(regexp_extract_all({0}, '(?:^|[^0-9])([0-9]{{3,4}})', 1), lambda y: y::INTEGER), lambda y: y BETWEEN 100 AND 2100) END"
query("parse_years", f"SELECT label, array_to_string({_YEARS_SQL.format('label')}, ',') AS years FROM {_labels_sql(X.PERIODS)}")(lambda s, d: _labels(s, d, X.PERIODS).drop("_k").withColumn("years", F.array_join(F.transform(expr.parse_years(F.col("label")), lambda y: y.cast("string")), ",")))
query("year_of", f"SELECT date, CASE WHEN y BETWEEN 1 AND 2100 THEN CASE WHEN trim(date) LIKE '-%' THEN -y ELSE y END END AS year FROM (SELECT date, TRY_CAST(regexp_extract(trim(date), '^-?(\\d+)(?:-|$)', 1) AS INTEGER) AS y FROM {spread_sql(X.DATES, 'orders', 'o_orderkey', (_1392,))})")(lambda s, d: spread(s, d, X.DATES, "orders", "o_orderkey", (_1392,)).drop("_k").withColumn("year", expr.year_of(F.col("date"))))
_PAGE = (("http://x/", "url", "url"),)
query("redact", f"SELECT url, regexp_replace(url, '((?:serviceKey|apiKey|authKey)=)[^&\\s]+', '\\1***', 'gi') AS shown FROM {spread_sql(X.URLS, 'pages', 'page_id', _PAGE)}")(lambda s, d: spread(s, d, X.URLS, "pages", "page_id", _PAGE).select("url", expr.redact(F.col("url")).alias("shown")))
query("cache_key", f"SELECT url, substr(sha256(url || '|' || coalesce(body, '')), 1, 32) AS key FROM {spread_sql(X.URLS, 'pages', 'page_id', _PAGE)}")(lambda s, d: spread(s, d, X.URLS, "pages", "page_id", _PAGE).select("url", expr.cache_key(F.col("url"), F.col("body")).alias("key")))
_SIZE = (("19621220", "concat('19', lpad(cast(p_size as string), 2, '0'), '1220')", "'19' || lpad(p_size::VARCHAR, 2, '0') || '1220'"), ("126.97", "p_retailprice", "p_retailprice"))
query("parse_designated_date", f"SELECT day, CASE WHEN regexp_matches(day, '^\\d{{8}}$') THEN substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) END AS iso FROM {spread_sql(X.SCALARS, 'part', 'p_partkey', _SIZE)}")(lambda s, d: spread(s, d, X.SCALARS, "part", "p_partkey", _SIZE).select("day", expr.designated_date(F.col("day")).alias("iso")))
query("as_float", f"SELECT number, TRY_CAST(trim(number) AS DOUBLE) AS value FROM {spread_sql(X.SCALARS, 'part', 'p_partkey', _SIZE)}")(lambda s, d: spread(s, d, X.SCALARS, "part", "p_partkey", _SIZE).select("number", expr.to_double(F.col("number")).alias("value")))
_SOURCE = (('"a"', "concat('\"', source, '\"')", "'\"' || source || '\"'"),)
query("json_coerce", f"SELECT _k AS doc_id, CASE id WHEN 1 THEN source WHEN 2 THEN 'c' WHEN 3 THEN 'e' WHEN 5 THEN 'g' END AS subject, CASE id WHEN 1 THEN 'created' WHEN 2 THEN 'created' WHEN 3 THEN 'related_to' WHEN 5 THEN 'r' END AS relation, CASE WHEN id IN (4, 6) THEN NULL ELSE 1 END AS n FROM {spread_sql(X.ANSWERS, 'documents', 'doc_id', _SOURCE)} JOIN documents ON doc_id = _k")(
    lambda s, d: spread(s, d, X.ANSWERS, "documents", "doc_id", _SOURCE).withColumn("r", expr.relations_json(F.col("text"))).select(F.col("_k").alias("doc_id"), F.col("r")[0]["subject"].alias("subject"), F.col("r")[0]["relation"].alias("relation"), F.when(F.size("r") > 0, F.size("r")).alias("n"))
)
query("json_set_props", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"seen\":\"yes\"}' AS props FROM events")(lambda s, d: read(s, d, "events").select("event_id", expr.json_set(F.col("props"), "seen", F.lit("yes")).alias("props")))
query("event_years", "SELECT year(ts)::INTEGER AS year, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")(lambda s, d: read(s, d, "events").groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))

# --- resolution and time ----------------------------------------------------------------------

_N = f"nodes AS (SELECT DISTINCT id, type, CASE WHEN type = 'place' AND source = 'wd' THEN _k || label ELSE label END AS label, source, start_date, end_date, {_FILL} AS props, CASE WHEN type = 'event' THEN repeat('.', (_k::INTEGER * 997 + length(label) * 13) % 8000) ELSE description END AS description FROM {copies_sql(X.NODES, OWN_NODES)}), edges AS (SELECT DISTINCT * EXCLUDE (_k) FROM {copies_sql(X.EDGES, OWN_NODES)}), aliases AS (SELECT DISTINCT node_id, alias FROM {copies_sql(X.ALIASES, OWN_NODES)}), relations AS (SELECT DISTINCT * EXCLUDE (_k) FROM {copies_sql(X.RELATIONS, OWN_NODES)})"
_POL_ID = "CASE p[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in expr.POLITY_IDS.items()) + " END"
query("link_periods", f"WITH {_N} SELECT id AS a, 'wd:' || {_POL_ID} AS b, 'period_polity' AS method, 1.0::DOUBLE AS score FROM (SELECT id, CASE WHEN list_contains(p, '통일신라') THEN list_filter(p, lambda x: x <> '신라') ELSE p END AS p FROM (SELECT id, list_distinct(regexp_extract_all(label, '{_POL}')) AS p FROM nodes WHERE type = 'period' AND source = 'khs')) WHERE len(p) = 1 AND 'wd:' || {_POL_ID} IN (SELECT id FROM nodes)")(
    lambda s, d: resolve.link_periods(fixture_nodes(s, d))
)
query("link_places", f"WITH {_N}, known AS (SELECT {_PLACE_SQL.format('trim(label)')} AS name, min(id) AS id FROM nodes WHERE type = 'place' AND source = 'wd' GROUP BY 1 HAVING count(*) = 1), own AS (SELECT id, {_PLACE_SQL.format(chr(40) + 'json_extract_string(props, ' + repr('$.sigungu') + '))')} AS g, {_PLACE_SQL.format(chr(40) + 'json_extract_string(props, ' + repr('$.sido') + '))')} AS s FROM nodes WHERE type = 'place' AND source = 'khs') SELECT o.id AS a, coalesce(x.id, y.id) AS b, 'place_label_exact' AS method, 0.9::DOUBLE AS score FROM own o LEFT JOIN known x ON x.name = g LEFT JOIN known y ON y.name = s WHERE coalesce(x.id, y.id) IS NOT NULL")(
    lambda s, d: resolve.link_places(fixture_nodes(s, d))
)
query("bridge_report", sql("SELECT 'total' AS metric, count(*) AS n FROM same_as UNION ALL SELECT 'cross_source', count(*) FROM same_as JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.source <> y.source UNION ALL SELECT 'reaching', count(DISTINCT src) FROM edges JOIN same_as ON a = dst JOIN nodes n ON n.id = src WHERE n.source = 'cust' UNION ALL SELECT 'method:' || method, count(*) FROM same_as GROUP BY method"))(
    lambda s, d: resolve.bridge_report(nodes(s, d), edges(s, d), same_as(s, d), "cust")
)
query("timeline_label_links", f"WITH {_N} SELECT id AS a, 'time:' || y[1] AS b, 'year_from_label' AS method, 0.95::DOUBLE AS score FROM (SELECT id, {_YEARS_SQL.format('label')} AS y FROM nodes WHERE type = 'period' AND NOT starts_with(id, 'time:')) WHERE len(y) > 0")(lambda s, d: resolve.year_links(fixture_nodes(s, d)))
query("timeline_dated_to", sql("SELECT id AS src, 'time:' || substr(start_date, 1, 4)::INTEGER AS dst, 'dated_to' AS type, 'timeline' AS source, '시작' AS label FROM nodes WHERE start_date IS NOT NULL"))(lambda s, d: resolve.dated_edges(nodes(s, d)))
query("timeline_year_nodes", sql("SELECT DISTINCT 'time:' || y AS id, 'period' AS type, y || '년' AS label, 'timeline' AS source, lpad(y::VARCHAR, 4, '0') AS start_date FROM (SELECT substr(start_date, 1, 4)::INTEGER AS y FROM nodes WHERE start_date IS NOT NULL)"))(
    lambda s, d: resolve.year_nodes(resolve.dated_edges(nodes(s, d)).select(F.substring_index("dst", ":", -1).cast("int").alias("year")))
)
query("whats_in", sql("SELECT label, type, '시작' AS rel, 'dated_to' AS via FROM nodes WHERE start_date LIKE '1996%' UNION SELECT label, type, 'year_from_label', 'same_as' FROM nodes WHERE id = 'r:1' ORDER BY type, label, rel, via LIMIT 100000"))(
    lambda s, d: resolve.whats_in(nodes(s, d), resolve.dated_edges(nodes(s, d)), same_as(s, d).union(literal(s, [("r:1", "time:1996", "year_from_label", 0.95)], "a string, b string, method string, score double")), 1996, limit=100_000)
)
query("timeline_report", f"WITH {_N}, p AS (SELECT {_YEARS_SQL.format('label')} AS y FROM nodes WHERE type = 'period'), d AS (SELECT DISTINCT id, y FROM (SELECT id, substr(start_date, 1, 4)::INTEGER AS y FROM nodes WHERE start_date IS NOT NULL UNION ALL SELECT id, substr(end_date, 1, 4)::INTEGER FROM nodes WHERE end_date IS NOT NULL)), a AS (SELECT y FROM d UNION SELECT y[1] FROM p WHERE len(y) > 0) SELECT 'labels_linked' AS metric, count(*) FILTER (WHERE len(y) > 0) AS n FROM p UNION ALL SELECT 'labels_unparsed', count(*) FILTER (WHERE len(y) = 0) FROM p UNION ALL SELECT 'from_year', min(y) FROM a UNION ALL SELECT 'to_year', max(y) FROM a UNION ALL SELECT 'years', count(*) FROM a UNION ALL SELECT 'dated', count(*) FROM d")(
    lambda s, d: resolve.timeline(fixture_nodes(s, d))[3]
)

# --- documents and extraction -----------------------------------------------------------------


def prose(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 2 == 0, "event").otherwise("org").alias("type"), F.col("source").alias("label"), F.col("text").alias("description"))


_PROSE = "prose AS (SELECT 'd:' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'event' ELSE 'org' END AS type, source AS label, text AS description FROM documents)"
_SCORE = f"(CASE WHEN regexp_matches(description, '{LATIN[0]}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(description, '{LATIN[1]}') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(description, '{LATIN[2]}') THEN 0.5 ELSE 0 END + least(length(description) / 4000, 0.5))::DOUBLE"
query("narrative_score", f"WITH {_PROSE} SELECT id, round({_SCORE}, 6) AS score FROM prose")(lambda s, d: prose(s, d).select("id", F.round(expr.narrative_score(F.col("description"), *LATIN), 6).alias("score")))
_DENSITY = f"coalesce((len(regexp_extract_all({{0}}, '{LATIN[0]}')) + len(regexp_extract_all({{0}}, '{LATIN[1]}'))) / nullif(length({{0}}) / 1000, 0), 0)::DOUBLE"
query("chunk_density", f"WITH {_PROSE} SELECT id, round({_DENSITY.format('description')}, 6) AS density FROM prose")(lambda s, d: prose(s, d).select("id", F.round(expr.hint_density(F.col("description"), *LATIN[:2]), 6).alias("density")))
_SPLIT = """, paragraphs AS (SELECT id, label, string_split(description, chr(10)) AS p, description FROM prose),
 fold AS (
  SELECT id, label, p, 1 AS i, p[1] AS held, []::VARCHAR[] AS done FROM paragraphs WHERE length(description) > 6000
  UNION ALL
  SELECT id, label, p, i + 1, CASE WHEN held <> '' AND length(held) + length(p[i + 1]) + 1 > 6000 THEN right(held, 400) || chr(10) || p[i + 1] WHEN held <> '' THEN held || chr(10) || p[i + 1] ELSE p[i + 1] END,
         CASE WHEN held <> '' AND length(held) + length(p[i + 1]) + 1 > 6000 THEN list_append(done, held) ELSE done END
  FROM fold WHERE i < len(p)
 ), ends AS (
  SELECT id, label, CASE WHEN trim(held, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN list_append(done, held) ELSE done END AS c FROM fold WHERE i = len(p)
  UNION ALL SELECT id, label, [description] FROM paragraphs WHERE length(description) <= 6000
 ), chunks AS (SELECT id AS node_id, label, len(c)::INTEGER AS total_chunks, (k - 1)::INTEGER AS chunk, c[k] AS text FROM (SELECT *, unnest(range(1, len(c) + 1)) AS k FROM ends))
"""
query("split_documents", f"WITH RECURSIVE {_PROSE}{_SPLIT} SELECT node_id, label, total_chunks, chunk, text FROM chunks")(lambda s, d: documents.split_documents(prose(s, d)))
query("pick_chunks", f"WITH RECURSIVE {_PROSE}{_SPLIT} SELECT node_id, chunk FROM (SELECT node_id, chunk, row_number() OVER (PARTITION BY node_id ORDER BY {_DENSITY.format('text')} DESC, chunk) AS r FROM chunks) WHERE r <= 2")(lambda s, d: documents.pick_chunks(documents.split_documents(prose(s, d)), 2, *LATIN[:2]).select("node_id", "chunk"))
query("load_documents", f"WITH RECURSIVE {_PROSE}{_SPLIT}, best AS (SELECT id FROM (SELECT id, {_SCORE} AS score FROM prose WHERE type = 'event' AND length(description) > 100) WHERE score >= 1 ORDER BY score DESC, id LIMIT 50) SELECT node_id, chunk, text FROM chunks WHERE node_id IN (SELECT id FROM best)")(
    lambda s, d: documents.load_documents(prose(s, d), _covering(s, d), limit=50, types=("event",), hints=LATIN).select("node_id", "chunk", "text")
)


def _covering(s: SparkSession, d: str) -> DataFrame:
    """Every third document was met in an infobox."""
    return prose(s, d).where("cast(substr(id, 3) as bigint) % 3 = 0").select(F.lit("wd:x").alias("src"), F.col("id").alias("dst"), F.lit("participated_in").alias("type"), F.lit("kowiki:infobox").alias("source"))


query("load_documents_narrowed", f"WITH RECURSIVE {_PROSE}{_SPLIT}, best AS (SELECT * FROM (SELECT id, type, description, {_SCORE} AS score FROM prose WHERE type IN ('event', 'org') AND length(description) > 100 AND substr(id, 3)::BIGINT % 5 <> 4) WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 200), worth AS (SELECT id FROM best WHERE NOT (type = 'event' AND substr(id, 3)::BIGINT % 3 = 0 AND length(description) < 4000)) SELECT node_id, chunk FROM (SELECT node_id, chunk, row_number() OVER (PARTITION BY node_id ORDER BY {_DENSITY.format('text')} DESC, chunk) AS r FROM chunks WHERE node_id IN (SELECT id FROM worth)) WHERE r <= 1")(
    lambda s, d: documents.load_documents(prose(s, d), _covering(s, d), limit=200, min_score=0.5, scope=prose(s, d).where("cast(substr(id, 3) as bigint) % 5 <> 4"), skip_covered=True, max_chunks=1, types=("event", "org"), hints=LATIN).select("node_id", "chunk")
)
query("structural_coverage", f"WITH {_N} SELECT id, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM (SELECT src AS id, type, source FROM edges UNION ALL SELECT dst, type, source FROM edges) WHERE source IN ('khs', 'kowiki:infobox', 'kowiki', 'wd') GROUP BY id")(lambda s, d: documents.coverage(small_edges(s, d)).select("id", F.array_join("types", ",").alias("types")))
query("worth_extracting", f"WITH {_N} SELECT id FROM nodes WHERE CASE WHEN type = 'heritage' THEN regexp_matches(description, '{expr.MAKER}') WHEN type = 'event' THEN NOT (id IN (SELECT unnest([src, dst]) FROM edges WHERE type = 'participated_in' AND source = 'kowiki:infobox') AND length(description) < 4000) ELSE true END")(
    lambda s, d: documents.worth_extracting(fixture_nodes(s, d), small_edges(s, d)).select("id")
)
query("evidence_supported", "SELECT doc_id, length(ev) >= 8 AND contains(body, left(ev, 25)) AS supported FROM (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 40) WHEN doc_id % 3 = 1 THEN left(text, 5) ELSE 'not in any document at all' END, '\\s+', '', 'g') AS ev, regexp_replace(text, '\\s+', '', 'g') AS body FROM documents)")(
    lambda s, d: read(s, d, "documents").select("doc_id", expr.evidence_supported(F.when(F.col("doc_id") % 3 == 0, F.substring("text", 11, 40)).when(F.col("doc_id") % 3 == 1, F.left("text", F.lit(5))).otherwise("not in any document at all"), F.col("text")).alias("supported"))
)
query("resolve_names", sql(", al AS (SELECT 'c:' || c_custkey AS node_id, 'Customer ' || c_nationkey AS alias FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'nobody' FROM nation), names AS (SELECT DISTINCT p_name AS name, 'artwork' AS kind FROM part UNION SELECT n_name, 'event' FROM nation UNION SELECT 'Customer ' || n_nationkey, 'person' FROM nation UNION SELECT 'order ' || o_orderkey || '?', 'event' FROM orders UNION SELECT 'nobody', 'person') SELECT name, kind, coalesce((SELECT min(id) FROM nodes WHERE label = name AND type = kind), (SELECT min(node_id) FROM al WHERE alias = name), (SELECT min(id) FROM nodes WHERE label = name), 'ex:' || kind || ':' || name) AS id FROM names"))(
    lambda s, d: documents.resolve_names(_names(s, d), nodes(s, d), _name_aliases(s, d)).select("name", "kind", "id")
)


def _names(s: SparkSession, d: str) -> DataFrame:
    """Names that each arm finds: by label and type, by alias, by label, and none."""
    n, customer = read(s, d, "nation"), F.concat(F.lit("Customer "), F.col("n_nationkey").cast("string"))
    parts = [read(s, d, "part").select(F.col("p_name").alias("name"), F.lit("artwork").alias("kind")), n.select("n_name", F.lit("event")), n.select(customer, F.lit("person")), read(s, d, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit("?")), F.lit("event")), s.range(1).select(F.lit("nobody"), F.lit("person"))]
    return reduce(DataFrame.union, parts).distinct()


def _name_aliases(s: SparkSession, d: str) -> DataFrame:
    own = read(s, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("Customer "), F.col("c_nationkey").cast("string")).alias("alias"))
    return own.union(read(s, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")), F.lit("nobody")))


def _extracted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = fixture_nodes(s, d).select(F.col("id").alias("source_node"), F.col("description").alias("text"))
    return documents.to_graph(small_relations(s, d).join(text, "source_node"), fixture_nodes(s, d), small_aliases(s, d))


_RULES = values([(k, *ends) for k, ends in ontology.EDGE_TYPES.items()], "type string, f array<string>, t array<string>")
_TYPES = ", ".join(f"'{t}'" for t in ontology.NODE_TYPES)
_EXTRACTED = f"""WITH {_N}, rules AS {_RULES}, good AS (SELECT r.* FROM relations r JOIN nodes n ON n.id = r.source_node WHERE r.relation IN (SELECT type FROM rules) AND length(regexp_replace(coalesce(evidence, ''), '\\s+', '', 'g')) >= 8 AND contains(regexp_replace(description, '\\s+', '', 'g'), left(regexp_replace(coalesce(evidence, ''), '\\s+', '', 'g'), 25)) AND subject_type IN ({_TYPES}) AND object_type IN ({_TYPES}) AND subject <> '' AND object <> ''),
 names AS (SELECT subject AS name, subject_type AS kind FROM good UNION SELECT object, object_type FROM good),
 known AS (SELECT name, kind, coalesce((SELECT min(id) FROM nodes WHERE label = name AND type = kind), (SELECT min(node_id) FROM aliases WHERE alias = name AND node_id IN (SELECT id FROM nodes)), (SELECT min(id) FROM nodes WHERE label = name), 'ex:' || kind || ':' || name) AS id FROM names),
 typed AS (SELECT known.*, coalesce(nodes.type, kind) AS type FROM known LEFT JOIN nodes USING (id)),
 ends AS (SELECT g.*, a.id AS a, a.type AS at_, b.id AS b, b.type AS bt, f, t FROM good g JOIN typed a ON a.name = subject AND a.kind = subject_type JOIN typed b ON b.name = object AND b.kind = object_type JOIN rules ON rules.type = relation),
 turned AS (SELECT *, CASE WHEN list_contains(f, at_) AND list_contains(t, bt) THEN false WHEN list_contains(f, bt) AND list_contains(t, at_) THEN true END AS flipped FROM ends),
 e AS (SELECT CASE WHEN flipped THEN b ELSE a END AS src, CASE WHEN flipped THEN a ELSE b END AS dst, relation AS type, CASE confidence WHEN 'certain' THEN 0.9 WHEN 'probable' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM turned WHERE flipped IS NOT NULL)"""
query("to_graph_nodes", f"{_EXTRACTED} SELECT DISTINCT id, kind AS type, name AS label FROM known WHERE id LIKE 'ex:%'")(lambda s, d: _extracted(s, d)[0].select("id", "type", "label"))
query("to_graph_edges", f"{_EXTRACTED} SELECT src, dst, type, confidence FROM e")(lambda s, d: _extracted(s, d)[1].select("src", "dst", "type", "confidence"))
query("extraction_quality", f"{_EXTRACTED} SELECT type, count(*) AS n, sum(CASE WHEN src NOT LIKE 'ex:%' AND dst NOT LIKE 'ex:%' THEN 1 ELSE 0 END)::BIGINT AS linked FROM e GROUP BY type")(lambda s, d: documents.extraction_quality(_extracted(s, d)[1]))
query("quality_report", f"{_EXTRACTED} SELECT 'relations' AS metric, count(*) AS n FROM e UNION ALL SELECT 'orphans', count(*) FROM e WHERE src LIKE 'ex:%' OR dst LIKE 'ex:%' UNION ALL SELECT 'supported', count(*) FROM e")(
    lambda s, d: documents.quality_report(_extracted(s, d)[1], documents.texts_of(documents.split_documents(fixture_nodes(s, d).where("description <> ''"))))
)

# --- sources ----------------------------------------------------------------------------------

OWN_EVENTS = ("wd:E1", "wd:E2", "wd:E3")
OWN_PAGES = ("Q31", "Q32", "Q33", "Q34", "wd:Q31", "wd:Q33")


def _links(s: SparkSession, d: str) -> DataFrame:
    return payloads.infobox_links(copies(s, d, X.WIKITEXT, OWN_EVENTS))


_INFOBOX = f"""WITH w AS {copies_sql(X.WIKITEXT, OWN_EVENTS)}, lines AS (SELECT event, unnest(string_split(wikitext, chr(10))) AS line FROM w), f AS (SELECT event, trim(regexp_extract(line, '^\\s*\\|\\s*([가-힣A-Za-z0-9_ ]+?)\\s*=', 1)) AS field, line FROM lines),
 links AS (SELECT event, field, trim(unnest(regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) AS target FROM f WHERE field IN ({', '.join(repr(k) for k in payloads.INFOBOX_FIELDS)})), l AS (SELECT * FROM links WHERE target <> '' AND NOT regexp_matches(target, '{payloads.LINK_SKIP}')),
 fields AS {values([(k, *v) for k, v in payloads.INFOBOX_FIELDS.items()], 'field string, kind string, wants string')}, hit AS (SELECT event, field, target, kind, 'wd:' || t.qid AS id, coalesce(k.type, x.type) AS type, k.id IS NULL AS fresh FROM l JOIN fields USING (field) JOIN {values(*X.TITLES)} AS t ON t.title = target LEFT JOIN {values(*X.KNOWN)} AS k ON k.id = 'wd:' || t.qid LEFT JOIN {values(*X.FETCHED)} AS x ON x.qid = t.qid WHERE coalesce(k.type, x.type) = wants)"""
query("infobox_links", f"{_INFOBOX} SELECT event, field, target FROM l")(lambda s, d: _links(s, d))
query("infobox_edges", f"{_INFOBOX} SELECT DISTINCT CASE WHEN kind = 'occurred_at' THEN event ELSE id END AS src, CASE WHEN kind = 'occurred_at' THEN id ELSE event END AS dst, kind AS type, 0.95::DOUBLE AS confidence FROM hit")(
    lambda s, d: payloads.infobox_edges(_links(s, d), lit(s, X.TITLES), lit(s, X.KNOWN), lit(s, X.FETCHED)).select("src", "dst", "type", "confidence")
)
query("infobox_nodes", f"{_INFOBOX} SELECT DISTINCT id, type, target AS label FROM hit WHERE fresh")(
    lambda s, d: payloads.infobox_nodes(payloads.infobox_edges(_links(s, d), lit(s, X.TITLES), lit(s, X.KNOWN), lit(s, X.FETCHED)), lit(s, X.TITLES), lit(s, X.FETCHED), lit(s, X.KNOWN))
)
OWN_TITLES = ("A", "b", "C", "B", "Bee", "Aye")
query("redirect_map", f"WITH w AS {copies_sql(X.WANTED, OWN_TITLES)}, n AS {copies_sql(([('b', 'B')], 'a string, b string'), OWN_TITLES)}, r AS {copies_sql(([('B', 'Bee'), ('A', 'Aye')], 'a string, b string'), OWN_TITLES)} SELECT title, coalesce(r.b, n.b, title) AS final FROM w LEFT JOIN n ON n.a = title LEFT JOIN r ON r.a = coalesce(n.b, title)")(
    lambda s, d: payloads.requested_titles(*(copies(s, d, x, OWN_TITLES).drop("_k") for x in (X.WANTED, X.NORMALIZED, X.REDIRECTS)))
)
query("labels_lookup", f"WITH {_T} SELECT s AS id, coalesce(min(o) FILTER (WHERE p = 'label' AND lang = 'ko'), min(o) FILTER (WHERE p = 'label' AND lang = 'en'), s) AS label, min(o) FILTER (WHERE p = 'P31') AS class FROM t GROUP BY s")(lambda s, d: payloads.labels(triples(s, d)))
query("aliases_lookup", f"WITH {_T} SELECT DISTINCT 'wd:' || s AS node_id, o AS alias FROM t WHERE p = 'altLabel' AND lang = 'ko'")(lambda s, d: payloads.aliases(triples(s, d)))
query("sparql_persons", f"WITH {_T}, q AS {values(*X.POLITIES)}, h AS (SELECT t.s, q.label, row_number() OVER (PARTITION BY t.s ORDER BY seq) AS k FROM t JOIN q ON t.o = q.qid WHERE t.p = 'P27' AND t.s IN (SELECT s FROM t WHERE p = 'P31' AND o = 'Q5')) SELECT 'wd:' || h.s AS id, label AS polity, (SELECT min(split_part(o, 'T', 1)) FROM t WHERE t.s = h.s AND p = 'P569') AS start_date, (SELECT min(split_part(o, 'T', 1)) FROM t WHERE t.s = h.s AND p = 'P570') AS end_date FROM h WHERE k = 1")(
    lambda s, d: payloads.persons(triples(s, d), lit(s, X.POLITIES))
)
_DOWNGRADED = f"""WITH {_T}, q AS {values(*X.POLITIES)}, rules AS {_RULES}, rel AS {values(list(payloads.PERSON_PROPERTIES.items()), 'p string, kind string')}, cls AS {values(list(payloads.CLASS_TYPES.items()), 'class string, type string')}, inf AS {values(list(payloads.INFERRED.items()), 'kind string, type string')},
 people AS (SELECT DISTINCT s FROM t WHERE p = 'P27' AND o IN (SELECT qid FROM q) AND s IN (SELECT s FROM t WHERE p = 'P31' AND o = 'Q5')), own AS (SELECT s, min(o) AS class FROM t WHERE p = 'P31' GROUP BY s),
 r AS (SELECT t.s, t.o, rel.kind, coalesce(cls.type, inf.type, 'person') AS target FROM t JOIN rel USING (p) LEFT JOIN own ON own.s = t.o LEFT JOIN cls ON cls.class = own.class LEFT JOIN inf ON inf.kind = rel.kind WHERE t.s IN (SELECT s FROM people)), x AS (SELECT r.*, list_contains(f, 'person') AND list_contains(rules.t, target) AS ok FROM r JOIN rules ON rules.type = kind)
 SELECT 'wd:' || s AS src, 'wd:' || o AS dst, CASE WHEN ok THEN kind ELSE 'related_to' END AS type, max(CASE WHEN NOT ok THEN kind END) AS original_type FROM x GROUP BY 1, 2, 3"""
query("sparql_relations_downgrade", _DOWNGRADED)(lambda s, d: payloads.person_relations(triples(s, d), payloads.persons(triples(s, d), lit(s, X.POLITIES))))
query("sparql_events", f"WITH RECURSIVE {_T}, q AS {values(*X.POLITIES)}, c AS (SELECT s AS id, o AS class FROM t WHERE p = 'P31' UNION SELECT c.id, t.o FROM c JOIN t ON t.s = c.class AND t.p = 'P279'), l AS (SELECT s, min(o) FILTER (WHERE lang = 'ko') AS label FROM t WHERE p = 'label' GROUP BY s), e AS (SELECT id, min(class) AS root FROM c WHERE class IN ('Q1190554', 'Q178561', 'Q198', 'Q625298') AND id IN (SELECT s FROM t WHERE p = 'P17' AND o IN (SELECT qid FROM q)) GROUP BY id) SELECT 'wd:' || id AS id, 'event' AS type, coalesce(label, id) AS label, (SELECT min(split_part(o, 'T', 1)) FROM t WHERE t.s = e.id AND p = 'P580') AS start_date, CASE root WHEN 'Q1190554' THEN '사건' WHEN 'Q178561' THEN '전투' WHEN 'Q198' THEN '전쟁' ELSE '조약' END AS event_class FROM e LEFT JOIN l ON l.s = e.id UNION ALL SELECT DISTINCT 'wd:' || o, 'place', o, NULL, NULL FROM t WHERE p = 'P276' AND s IN (SELECT id FROM e)")(
    lambda s, d: payloads.events(triples(s, d), lit(s, X.POLITIES))[0].select("id", "type", "label", "start_date", "event_class")
)
query("sparql_media", f"WITH {_T} SELECT 'wd:' || s AS src, 'wd:' || o AS dst, 'depicts' AS type FROM t WHERE p = 'P921' AND s IN (SELECT s FROM t WHERE p = 'P31' AND o IN ('Q11424', 'Q5398426')) AND s IN (SELECT s FROM t WHERE p = 'P495' AND o = 'Q884')")(lambda s, d: payloads.media(triples(s, d)))
query("media_nodes", f"WITH {_T}, m AS (SELECT s, o FROM t WHERE p = 'P921' AND s IN (SELECT s FROM t WHERE p = 'P31' AND o IN ('Q11424', 'Q5398426')) AND s IN (SELECT s FROM t WHERE p = 'P495' AND o = 'Q884')), i AS (SELECT DISTINCT s AS q, 'media' AS type FROM m UNION SELECT o, 'event' FROM m WHERE o NOT IN (SELECT s FROM m)) SELECT 'wd:' || q AS id, type, coalesce((SELECT min(o) FROM t WHERE s = q AND p = 'label' AND lang = 'ko'), (SELECT min(o) FROM t WHERE s = q AND p = 'label' AND lang = 'en'), q) AS label, CASE WHEN type = 'media' THEN (SELECT min(split_part(o, 'T', 1)) FROM t WHERE s = q AND p = 'P577') END AS start_date, 'http://www.wikidata.org/entity/' || q AS url FROM i")(lambda s, d: payloads.media_nodes(triples(s, d)))
query("first_mapped_class", f"WITH {_T}, cls AS {values(list(payloads.CLASS_TYPES.items()), 'class string, type string')} SELECT s AS qid, arg_min(type, o) AS type FROM t JOIN cls ON class = o WHERE p = 'P31' GROUP BY s")(lambda s, d: payloads.first_mapped_class(triples(s, d)))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Documents as answers of a wiki, a list or a map of pages each; some are missing, some empty, some no JSON."""
    k = F.col("doc_id")
    page = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("title"), F.when(k % 5 == 0, F.lit(True)).alias("missing"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.left("text", F.lit(300)), F.lit("."))).alias("extract"))
    text = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))).otherwise(F.to_json(F.struct(F.struct(F.create_map(k.cast("string"), page).alias("pages")).alias("query"))))
    return read(s, d, "documents").select(F.when(k % 11 == 0, "<html>").otherwise(text).alias("text"))


query("extracts", "SELECT 'T' || doc_id AS title, sha256(regexp_replace(left(coalesce(text, ''), 300) || '.', '^\\s+', '')) AS digest FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND text IS NOT NULL")(lambda s, d: payloads.extracts(_answers(s, d)).select("title", F.sha2("extract", 256).alias("digest")))
query("sitelink_titles", "SELECT 'Q' || page_id // 3 AS qid, arg_max(url, page_id) AS title FROM pages WHERE page_id % 4 <> 0 GROUP BY 1")(
    lambda s, d: payloads.titles(read(s, d, "pages").select(F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.expr("page_id div 3").cast("string")).alias("item"), F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("title"), F.col("page_id").alias("seq")))
)
query("page_names", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")(lambda s, d: read(s, d, "pages").select("page_id", expr.last_segment(F.col("url")).alias("name")))
query("edge_violations", sql("SELECT violation, count(*) AS n FROM (SELECT CASE WHEN type = 'born_in' THEN 'type' WHEN type IN ('located_in', 'occurred_at') THEN 'confidence' END AS violation FROM edges) GROUP BY violation"))(
    lambda s, d: edges(s, d).select(ontology.edge_violation(F.when(F.col("type") != "born_in", F.col("type")), F.when(F.col("type") == "located_in", 0.0).when(F.col("type") == "occurred_at", 1.5).otherwise(F.col("confidence"))).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
)


def _bound(s: SparkSession, d: str) -> DataFrame:
    """Customers as answers of a triple store, one or two bindings each; some variables are unbound, some answers no JSON."""
    k = F.col("c_custkey")

    def cell(v: Column) -> Column:
        return F.struct(F.lit("literal").alias("type"), v.alias("value"))

    first = F.struct(cell(F.col("c_name")).alias("e"), F.when(k % 3 != 0, cell(F.col("c_mktsegment"))).alias("l"))
    rows = F.when(k % 2 == 0, F.array(first)).otherwise(F.array(first, F.struct(cell(k.cast("string")).alias("e"), F.when(F.lit(False), cell(F.lit(""))).alias("l"))))
    text = F.to_json(F.struct(F.struct(rows.alias("bindings")).alias("results")))
    return read(s, d, "customer").select(k.alias("key"), F.when(k % 13 == 0, "busy").otherwise(text).alias("text"))


query("bindings", "SELECT c_custkey AS key, c_name AS e, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS l FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT c_custkey, c_custkey::VARCHAR, NULL FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 2 = 1")(lambda s, d: payloads.bindings(_bound(s, d), ["e", "l"]))


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    """Parts in the envelopes of an API, a list of two or a single one."""
    k, item = F.col("p_partkey"), F.struct(F.col("p_name").alias("name"))

    def envelope(items: Column) -> Column:
        return F.to_json(F.struct(F.struct(F.struct(F.struct(items.alias("item")).alias("items")).alias("body")).alias("response")))

    return read(s, d, "part").select(k.alias("key"), F.when(k % 5 == 0, "{}").when(k % 2 == 0, envelope(item)).otherwise(envelope(F.array(item, F.struct(F.col("p_brand").alias("name"))))).alias("text"))


query("json_items", "SELECT p_partkey AS key, p_name AS name FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 1")(lambda s, d: payloads.json_items(_envelopes(s, d), "struct<name:string>"))
_NUMBER = (("0001", "p_partkey", "p_partkey"),)
query("xml_heritage", "SELECT 'khs:11-11-' || p_partkey AS id, 'heritage' AS type, '숭례문' AS label FROM part UNION ALL SELECT 'kr:place:서울:중구', 'place', '서울 중구' UNION ALL SELECT 'kr:period:조선시대', 'period', '조선시대'")(
    lambda s, d: payloads.heritage(payloads.xml_items(spread(s, d, X.ITEMS, "part", "p_partkey", _NUMBER).drop("_k")))[0].select("id", "type", "label")
)
_URL = "https://ko.wikipedia.org/wiki/"
query("enrich_update", f"WITH {_N}, w AS {copies_sql(X.SITELINKS, OWN_QIDS)}, x AS {values(*X.EXTRACTS)}, u AS (SELECT 'wd:' || qid AS id, title, extract FROM w JOIN x USING (title)) SELECT n.id, CASE WHEN u.id IS NOT NULL THEN u.extract ELSE n.description END AS description, CASE WHEN u.id IS NOT NULL THEN replace(props, '}}', ',\"kowiki_url\":\"{_URL}' || url_encode(u.title) || '\"}}') ELSE props END AS props FROM nodes n LEFT JOIN u ON u.id = n.id AND n.source = 'wd' AND n.type IN ('person', 'event')")(
    lambda s, d: payloads.enrich(fixture_nodes(s, d), payloads.to_enrich(fixture_nodes(s, d), small_edges(s, d), limit=1 << 30), copies(s, d, X.SITELINKS, OWN_QIDS), lit(s, X.EXTRACTS)).select("id", "description", "props")
)
query("enrich_order", f"WITH {_N}, i AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) SELECT id, count(i.id) AS degree FROM nodes LEFT JOIN i USING (id) WHERE source = 'wd' AND type IN ('person', 'event') AND coalesce(length(description), 0) < 100 GROUP BY id ORDER BY degree DESC, id LIMIT 50")(
    lambda s, d: payloads.to_enrich(fixture_nodes(s, d), small_edges(s, d), limit=50).select("id", "degree")
)


def _canned() -> extraction.Backend:
    found = [{"subject": "세종", "subject_type": "person", "relation": "created", "object": "숭례문", "object_type": "heritage", "evidence": "만든 문", "confidence": "certain"}]
    return extraction.Canned({"즉위하고": found})


@query("model_extract", "SELECT 'khs:1-' || s_suppkey AS node_id, '세종' AS subject, 'created' AS relation, '숭례문' AS object, 'certain' AS confidence FROM supplier")
def _model_extract(s: SparkSession, d: str) -> DataFrame:
    n = fixture_nodes(s, d).where("description is not null")
    return extraction.extract(documents.split_documents(n), graph.gazetteer(fixture_nodes(s, d), small_edges(s, d)), "relations", _canned).select("node_id", "subject", "relation", "object", "confidence")


from . import ingested  # noqa: E402, F401  its queries are added to those above
