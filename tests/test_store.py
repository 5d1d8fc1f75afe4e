"""The store: folding in any order, buckets, several tables at once, torn and competing writes, checks on the way, streams."""

import itertools
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronolith.functions import ontology
from chronolith.operators import graph
from chronolith.plans import fixtures as X
from chronolith.plans.view import literal
from chronolith.sources import persist
from chronolith.sources.graphstore import TABLES, Conflict, GraphStore, folded, numbered
from chronolith.streaming import ingest

BATCHES = [
    [("a:1", "person", "x", "s", "1", None), ("a:2", "event", "e", "s", None, None)],
    [("a:1", "event", "y", "t", None, "9"), ("a:3", "place", "p", "s", None, None)],
    [("a:1", "role", "z", "u", None, None), ("a:2", "role", "f", "t", "7", None)],
]
WANT = {("a:1", "person", "z", "s", "1", "9"), ("a:2", "event", "f", "s", "7", None), ("a:3", "place", "p", "s", None, None)}
COLUMNS = "id string, type string, label string, source string, start_date string, end_date string"


def batch(spark, k):
    return literal(spark, BATCHES[k], COLUMNS)


def rows(store, version=None):
    return {tuple(r) for r in store.read("nodes", version).select("id", "type", "label", "source", "start_date", "end_date").collect()}


def test_batches_fold_in_any_order(spark):
    """Any order, repetitions and partial folds of the same numbered batches give the same rows."""
    t = TABLES["nodes"]
    parts = [numbered(batch(spark, k), t, F.lit(k)) for k in range(3)]
    for order in itertools.permutations(range(3)):
        a, b, c = (parts[k] for k in order)
        once = folded(folded(a.unionByName(b), t).unionByName(c).unionByName(a), t)
        got = {tuple(r) for r in once.select("id", "type", "label", "source", "start_date", "end_date").collect()}
        assert got == WANT


def test_versions_buckets_and_deletes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 8)
    assert store.manifest().version == 0 and store.read("nodes").isEmpty()
    for k in range(3):
        tx = store.begin()
        tx.append("nodes", batch(spark, k))
        tx.append("aliases", literal(spark, [("a:1", "n"), ("a:2", str(k))], "node_id string, alias string"))
        tx.append("edges", literal(spark, [("a:1", "a:2", "participated_in", "s", f"l{k}"), ("a:3", "a:3", "part_of", "s", "")], "src string, dst string, type string, source string, label string"))
        tx.commit()
    assert rows(store) == WANT and store.read("aliases").count() == 4
    assert rows(store, 1) == {(*r[:4], r[4], r[5]) for r in BATCHES[0]}
    before = store.manifest().tables["nodes"]
    tx = store.begin()
    assert tx.compact("nodes") == sorted(b for b, s in before.items() if len(s) > 1)
    done = tx.commit()
    assert rows(store) == WANT and all(len(s) == 1 for s in done.tables["nodes"].values())
    tx = store.begin()
    tx.delete_nodes(spark.createDataFrame([("a:2",), ("none:1",)], "id string"))
    tx.commit()
    assert {r[0] for r in rows(store)} == {"a:1", "a:3"} and [r.src for r in store.read("edges").collect()] == ["a:3"]
    assert {r.node_id for r in store.read("aliases").collect()} == {"a:1"}
    assert rows(store, done.version) == WANT
    persist.reset(store)
    assert store.read("nodes").isEmpty() and rows(store, done.version) == WANT
    with pytest.raises(LookupError):
        store.manifest(99)


def test_deletions_compute_their_keys_once(spark, tmp_path):
    """Keys are computed once however many buckets they are in; null keys equal none; untouched buckets stay; what goes is written no more."""
    store = GraphStore(spark, str(tmp_path / "g"), 8)
    fields = "src string, dst string, type string, source string, label string"
    rows = [(f"a:{k}", f"b:{k % 5}", "part_of", "s", "x") for k in range(40)] + [(None, "b:9", "part_of", "s", "x")]
    tx = store.begin()
    tx.merge("edges", spark.createDataFrame(rows, fields))
    tx.merge("nodes", spark.createDataFrame([(f"a:{k}", "person", "x", "s") for k in range(40)] + [("b:1", "place", "x", "s")], "id string, type string, label string, source string"))
    tx.merge("aliases", spark.createDataFrame([("b:1", "n"), ("a:1", "m")], "node_id string, alias string"))
    before = tx.commit()
    assert all(n.endswith("-whole") for n in store._names("segments"))
    tx, seen = store.begin(), spark.sparkContext.accumulator(0)

    def key(r):
        seen.add(1)
        return r

    gone = [("a:1", "b:1", "part_of", "s"), ("a:2", "b:2", "part_of", "s"), (None, "b:9", "part_of", "s"), ("z:1", "b:1", "part_of", "s")]
    todo = tx.delete("edges", spark.createDataFrame(spark.sparkContext.parallelize(gone, 2).map(key), "src string, dst string, type string, source string"))
    after = tx.commit()
    assert seen.value == len(gone)
    assert {b for b, s in before.tables["edges"].items() if after.tables["edges"].get(b) != s} <= set(todo) and len(todo) <= 3
    assert {r.src for r in store.read("edges").collect()} == {r[0] for r in rows} - {"a:1", "a:2"}
    seen.value = 0
    tx = store.begin()
    tx.delete_nodes(spark.createDataFrame(spark.sparkContext.parallelize([("b:1",), ("a:4",)], 1).map(key), "id string"))
    tx.commit()
    assert seen.value == 2
    assert {(r.src, r.dst) for r in store.read("edges").collect()} == {r[:2] for r in rows if r[1] != "b:1" and r[0] not in ("a:2", "a:4")}
    assert {r.node_id for r in store.read("aliases").collect()} == {"a:1"} and store.read("nodes").count() == 39


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 32)
    many = spark.range(400).select(F.concat(F.lit("a:"), F.col("id")).alias("id"), F.lit("person").alias("type"), F.lit("x").alias("label"), F.lit("s").alias("source"))
    tx = store.begin()
    tx.merge("nodes", many)
    before = tx.commit()
    tx = store.begin()
    touched = tx.merge("nodes", many.where("id in ('a:5', 'a:6', 'a:7', 'a:8')").withColumn("label", F.lit("y")))
    after = tx.commit()
    changed = {b for b, s in after.tables["nodes"].items() if s != before.tables["nodes"][b]}
    assert changed == set(touched) and len(changed) <= 4
    assert store.read("nodes").where("label = 'y'").count() == 4 and store.read("nodes").count() == 400


def test_competing_and_torn_writes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 4)
    a, b = store.begin(), store.begin()
    a.append("nodes", batch(spark, 0))
    b.append("nodes", batch(spark, 1))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert {r[0] for r in rows(store)} == {"a:1", "a:2"}  # nothing of the refused batch shows
    manifest = Path(tmp_path / "g" / "manifests" / f"{2:012d}")
    manifest.write_text(Path(tmp_path / "g" / "manifests" / f"{1:012d}").read_text()[:-5])
    assert store.manifest().version == 1
    tx = store.begin()
    tx.append("nodes", batch(spark, 1))
    with pytest.raises(Conflict):
        tx.commit()
    assert store.repair() == [f"{2:012d}"]
    tx = store.begin()
    tx.append("nodes", batch(spark, 1))
    assert tx.commit().version == 2


def test_checks_on_the_way(spark, tmp_path):
    """Distinct problems sorted, five at most; ends outside the batch are no problem; everything is stored and logged."""
    nodes = literal(spark, [(f"{t[0]}:{k}", t, "x", "s") for k, t in enumerate(ontology.NODE_TYPES)], "id string, type string, label string, source string")
    ids = [r.id for r in nodes.collect()]
    edges = literal(spark, [(a, b, "born_in", "s") for a in ids for b in ids] + [("x:1", "p:0", "born_in", "s")], "src string, dst string, type string, source string")
    store = GraphStore(spark, str(tmp_path / "g"), 4)
    r = persist.persist(store, "test", nodes, edges, datetime(2024, 1, 1))
    src = {"person"}
    n = len(ids)
    wrong_src, wrong_dst = (n - len(src)) * n, len(src) * (n - 1)
    assert (r.nodes, r.edges, r.problems) == (n, n * n + 1, wrong_src + wrong_dst)
    assert r.named == sorted([(f"born_in: src {t}", n) for t in ontology.NODE_TYPES if t != "person"] + [(f"born_in: dst {t}", 1) for t in ontology.NODE_TYPES if t != "place"])[:5]
    assert store.read("edges").count() == n * n + 1
    persist.persist(store, "again", nodes.limit(0), edges.limit(0), datetime(2024, 1, 2))
    assert [tuple(x)[1:4] for x in store.read("ingest_log").orderBy("version").collect()] == [("test", n, n * n + 1), ("again", 0, 0)]


def test_scope_as_a_store(spark, tmp_path):
    source, target = GraphStore(spark, str(tmp_path / "a"), 4), GraphStore(spark, str(tmp_path / "b"), 4)
    tx = source.begin()
    for name, fixture in (("nodes", X.NODES), ("edges", X.EDGES), ("same_as", X.SAME_AS)):
        tx.append(name, literal(spark, *fixture))
    tx.commit()
    done, stats = persist.save_scope(source, target, "조선", "wd:Q28179")
    ids = {r.id for r in persist.scope_ids(target).collect()}
    assert {"wd:Q10", "wd:Q37682", "wd:Q28179", "khs:1"} <= ids and done.version == 1
    assert {r.n for r in stats.where("metric = 'nodes'").collect()} == {len(ids)}
    with pytest.raises(LookupError):
        persist.save_scope(source, target, "none", "wd:none")
    assert target.manifest().version == 1
    assert target._names("segments") and all(n.endswith("-whole") for n in target._names("segments"))  # nothing to fold when it is read
    plan = target.read("edges")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("hops", [0, 1, 2])
def test_scope_without_what_nothing_touches(spark, hops):
    """Seeds and a polity without an edge or link go, by the same rule whether hops meet the others or not."""
    node = "id string, type string, label string, source string, props string"
    ids = [("p:1", "person"), ("p:2", "person"), ("p:3", "person"), ("p:4", "person"), ("e:1", "event"), ("e:2", "event"), ("x:1", "place"), ("x:2", "place"), ("x:3", "place"), ("q:1", "org")]
    nodes = literal(spark, [(i, t, i, "s", '{"polity":"A","seed_era":"A"}' if t in ("person", "event") else "{}") for i, t in ids], node)
    edges = [("p:1", "x:1"), ("x:1", "x:2"), ("x:2", "x:3"), ("p:3", "p:3"), ("e:1", "p:1")]
    same = [("p:4", "y:1")]
    e = literal(spark, [(a, b, "related_to", "s") for a, b in edges], "src string, dst string, type string, source string")
    s = literal(spark, [(a, b, "hand", 1.0) for a, b in same], "a string, b string, method string, score double")
    for polity in ("q:1", "x:3"):
        keep = {i for i, t in ids if t in ("person", "event")}
        for _ in range(hops):
            keep |= {y for a, b in edges + same for x, y in ((a, b), (b, a)) if x in keep}
        keep |= {polity}
        for drop in (False, True):
            own = {x for x in keep if not drop or any(x in pair for pair in edges + same)}
            n, ee, ss = graph.scope(nodes, e, s, "A", polity, hops, drop)
            assert {r.id for r in n.collect()} == own & {i for i, _ in ids}
            assert {(r.src, r.dst) for r in ee.collect()} == {(a, b) for a, b in edges if {a, b} <= own}
            assert {(r.a, r.b) for r in ss.collect()} == {(a, b) for a, b in same if {a, b} <= own}
            keep_plan = graph.expand(graph.era_seeds(nodes, e, s, "A", polity), e, s, hops, only_linked=True) if hops else None
            assert keep_plan is None or "p:2" not in {r.id for r in keep_plan.collect()}


def test_epochs_come_once(spark, tmp_path):
    """A replayed epoch makes no version; late batches do not override newer values; repeated rows change nothing."""
    store = GraphStore(spark, str(tmp_path / "g"), 4)
    run = ingest.merge_batch(store, "nodes", "stream", F.col("at"), compact=2)
    stamped = [batch(spark, k).withColumn("at", F.lit(k)) for k in range(3)]
    for epoch, k in enumerate((2, 0, 1)):
        run(stamped[k], epoch)
    assert store.manifest().version == 3 and rows(store) == WANT
    run(stamped[0], 1)
    assert store.manifest().version == 3
    run(stamped[0], 3)
    assert rows(store) == WANT


def test_stream_drops_repeated_events(spark, tmp_path):
    fields = "key long, at timestamp, v string"
    spark.sql("select 1L as key, timestamp'2024-01-01' as at, 'a' as v union all select 1L, timestamp'2024-01-02', 'b' union all select 2L, timestamp'2024-01-01', 'c'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    out = ingest.deduplicated(stream, "at", ["key"], "30 days").writeStream.format("memory").queryName("deduplicated").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r.key for r in spark.table("deduplicated").collect()) == [1, 2]
