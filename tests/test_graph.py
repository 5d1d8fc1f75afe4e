"""The library's queries against SQL, and its operators on small cases."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith.functions import expr, ontology
from chronolith.operators import documents, extraction, graph, lineage, resolve, store
from chronolith.plans import fixtures as X
from chronolith.plans import registry
from chronolith.plans.view import literal
from chronolith.sources import payloads

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {t.rsplit('/', 1)[1][:-8]} AS FROM '{t}'")
    return c


def rows(df):
    out = df[sorted(df.columns)].astype(object)
    out = out.where(out.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_upsert_is_idempotent(spark):
    fields = ontology.NODE_FIELDS
    old = literal(spark, [("a:1", "person", "x", "s", "1", None, None, None, "d", None, "{}")], fields)
    new = literal(spark, [("a:1", "event", "y", "t", None, "9", 1.0, None, None, None, '{"k":1}')], fields).withColumn("seq", F.lit(0))
    once = store.upsert_nodes(old, new)
    want = [("a:1", "person", "y", "s", "1", "9", 1.0, None, "d", None, '{"k":1}')]
    assert [tuple(r) for r in once.collect()] == want
    assert [tuple(r) for r in store.upsert_nodes(once, new).collect()] == want


def test_deleting_cascades_to_aliases(spark):
    n, e, a = store.delete_nodes(literal(spark, *X.NODES), literal(spark, *X.EDGES), literal(spark, *X.ALIASES), spark.createDataFrame([("wd:Q10",)], "id string"))
    assert n.where("id = 'wd:Q10'").isEmpty() and e.where("src = 'wd:Q10' or dst = 'wd:Q10'").isEmpty()
    assert [r.node_id for r in a.collect()] == ["wd:Q37682"]


def test_neighbors_cross_identity_links(spark):
    tables = [literal(spark, *t) for t in (X.NODES, X.EDGES, X.SAME_AS)]
    far = graph.neighbors(*tables, "khs:1", 3)
    near = graph.neighbors(*tables, "khs:1", 3, follow_same_as=False)
    assert far.nodes.where("id = 'wd:Q10'").count() == 1 and near.nodes.where("id = 'wd:Q10'").isEmpty()
    assert graph.neighbors(*tables, "khs:1", 0).nodes.count() == 1


def test_chunks_overlap_and_keep_paragraphs(spark):
    text = "\n".join(f"{i} " + "x" * 500 for i in range(40))
    df = spark.createDataFrame([("a:1", "t", text), ("a:2", "t", "short")], "id string, label string, description string")
    got = documents.split_documents(df).orderBy("node_id", "chunk").collect()
    long = [r.text for r in got if r.node_id == "a:1"]
    assert len(long) == 4 and all(len(t) <= 6500 for t in long) and long[1].startswith(long[0][-400:])
    assert [r.text for r in got if r.node_id == "a:2"] == ["short"]


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(expr.narrative_score(F.lit("정몽주는 조선의 학자로 왕이 즉위한 뒤 처형되었다"))).first()[0] > 2
    assert one.select(expr.evidence_supported(F.lit("짧다"), F.lit("짧다"))).first()[0] is False
    assert one.select(expr.url_title(F.lit("a b/c"))).first()[0] == "a%20b/c"
    assert one.select(expr.title_of_url(F.lit("https://ko.wikipedia.org/wiki/a%20b_c"))).first()[0] == "a b c"


def test_salvaged_answers(spark):
    found = literal(spark, *X.ANSWERS).select("id", expr.relations_json(F.col("text")).alias("r")).collect()
    answers = {r.id: r.r and [(x.subject, x.relation, x.object) for x in r.r] for r in found}
    assert answers == {1: [("a", "created", "b")], 2: [("c", "created", "d")], 3: [("e", "related_to", "f")], 4: None, 5: [("g", "r", "h")], 6: None}


def test_sources(spark):
    links = {(r.event, r.field, r.target) for r in payloads.infobox_links(literal(spark, *X.WIKITEXT)).collect()}
    assert links == {("wd:E1", "지휘관1", "이순신"), ("wd:E1", "지휘관1", "권율"), ("wd:E1", "지휘관2", "도요토미"), ("wd:E1", "장소", "한산도")}
    one = spark.createDataFrame([("k", '{"results":{"bindings":[{"e":{"value":"Q1"}},{"e":{"value":"Q2"},"l":{"value":"x"}}]}}'), ("bad", "no json")], "key string, text string")
    assert {tuple(r) for r in payloads.bindings(one, ["e", "l"]).collect()} == {("k", "Q1", None), ("k", "Q2", "x")}
    items = spark.createDataFrame([('{"response":{"body":{"items":{"item":{"a":"1"}}}}}',), ('{"response":{"body":{"items":{"item":[{"a":"2"},{"a":"3"}]}}}}',)], "text string")
    assert {r.a for r in payloads.json_items(items, "struct<a:string>").collect()} == {"1", "2", "3"}
    errors = spark.createDataFrame([("<x><returnReasonCode>30</returnReasonCode></x>",), ("<x><errMsg>no</errMsg></x>",), ("<ok/>",)], "text string")
    assert [r.error for r in payloads.classified(errors).collect()] == ["30", "no", None]
    wanted = spark.createDataFrame([("u", None), ("v", None)], "url string, body string")
    stored = wanted.where("url = 'u'").select(expr.cache_key(F.col("url"), F.col("body")).alias("key"))
    assert [r.url for r in payloads.unfetched(wanted, stored).collect()] == ["v"]


def test_models_that_fail_or_need_repair(spark):
    class Broken:
        name, asked = "broken", 0

        def complete(self, system, user):
            self.asked += 1
            if "fail" in user:
                raise RuntimeError("no answer")
            return "{" if self.asked < 2 else '{"relations":[{"subject":"a","relation":"created","object":"b"}]}'

    chunks = spark.createDataFrame([("n:1", "x", 0, "text"), ("n:2", "x", 0, "fail")], "node_id string, label string, chunk int, text string").coalesce(1)
    names = spark.createDataFrame([("person", 1, "a")], "type string, rank int, label string")
    got = extraction.extract(chunks, names, "system", lambda: extraction.Repairing(Broken())).collect()
    assert [(r.node_id, r.subject) for r in got] == [("n:1", "a")]


def test_quality_and_pruning(spark):
    n, e, a = (literal(spark, *t) for t in (X.NODES, X.EDGES, X.ALIASES))
    left, _, _, report = resolve.prune(n, e, a, resolve.sports_by_label(n))
    assert left.where("id = 'wd:Q9'").isEmpty() and {r.metric: r.n for r in report.collect()} == {"nodes": 1, "edges": 1}
    props = [('{"extracted_from":"k:1","evidence":"만든 문"}', "ex:a"), ('{"extracted_from":"k:1","evidence":"없다"}', "b:1")]
    edges = spark.createDataFrame(props, "props string, src string").withColumn("dst", F.lit("c:1"))
    texts = documents.texts_of(spark.createDataFrame([("k:1", 1, "문 앞"), ("k:1", 0, "그가 만든 ")], "node_id string, chunk int, text string"))
    assert {r.metric: r.n for r in documents.quality_report(edges, texts).collect()} == {"relations": 2, "orphans": 1, "supported": 1}


def test_large_frontiers(spark, monkeypatch):
    """Frontiers that are too large to be sent to all tasks give what small ones give."""
    tables = [literal(spark, *t) for t in (X.NODES, X.EDGES, X.SAME_AS)]
    seeds = spark.createDataFrame([("khs:1",), ("wd:Q9",)], "id string")

    def found():
        g = graph.neighbors(*tables, "khs:1", 3)
        return sorted(map(tuple, g.nodes.select("id").collect())), sorted(map(tuple, g.edges.select("src", "dst", "type").collect())), sorted(map(tuple, g.same_as.collect())), sorted(map(tuple, graph.expand(seeds, *tables[1:], 2).collect()))

    small = found()
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(lineage, "SMALL", 0)
    assert found() == small
