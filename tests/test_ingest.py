"""Paged lists, redirects, the log of requests and incremental statistics on small cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.operators import incremental, redirects
from chronolith.plans import ingested
from chronolith.plans.view import literal
from chronolith.sources import heritage, payload_log
from chronolith.sources.graphstore import GraphStore


def page(total, *numbers):
    return f"<r><totalCnt>{total}</totalCnt>" + "".join(f"<item><ccbaAsno>{k}</ccbaAsno><ccbaMnm1>n{k}</ccbaMnm1></item>" for k in numbers) + "</r>"


def test_lists_end_where_they_should(spark):
    pages = [
        ("11", "11", 1, page(3, 1, 2)), ("11", "11", 2, page(3, 3)), ("11", "11", 3, page(3, 99)),  # the total is reached
        ("11", "21", 1, page(9, 4, 5)), ("11", "21", 2, "<r><item>"), ("11", "21", 3, page(9, 99)),  # broken
        ("11", "31", 1, page(9, 6, 7)), ("11", "31", 3, page(9, 99)),  # a gap
        ("12", "11", 1, page(0)), ("12", "11", 2, page(9, 99)),  # empty
        ("12", "21", 1, page("", 8)), ("12", "21", 2, page(9, 99)),  # no total
        ("12", "31", 2, page(9, 99)), ("12", "41", 1, None),
    ]
    got = heritage.listed(spark.createDataFrame(pages + pages[:1], heritage.PAGES), page_size=2)
    assert sorted(int(r.ccbaAsno) for r in got.collect()) == list(range(1, 9))


def test_paged_data_source(spark):
    """One partition for each kind and region; a list is asked for no page beyond its total."""

    def fetch(kdcd, ctcd, number):  # workers cannot import this module
        def page(total, *numbers):
            return f"<r><totalCnt>{total}</totalCnt>" + "".join(f"<item><ccbaAsno>{k}</ccbaAsno><ccbaMnm1>n{k}</ccbaMnm1></item>" for k in numbers) + "</r>"

        if ctcd == "31" or number > 3:
            return "<r></r>" if number == 1 else 1 / 0
        return page(5, *range(2 * number - 1, min(2 * number, 5) + 1))

    spark.dataSource.register(heritage.paged_list(fetch))
    got = spark.read.format("heritage_list").option("kinds", "11,12").option("regions", "11,31").option("pageSize", "2").load()
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r.kdcd, r.ctcd, r.page) for r in got.collect()) == sorted([(k, "11", p) for k in ("11", "12") for p in (1, 2, 3)] + [("11", "31", 1), ("12", "31", 1)])
    assert heritage.listed(got, 2).count() == 10


def test_redirects_of_any_length(spark):
    """Chains of 1 to 1,000 steps, trees, cycles, what leads into them, and titles that lead to themselves."""
    rng, links = random.Random(1), {}
    for n in (1, 2, 3, 7, 8, 9, 100, 1000):
        links |= {f"c{n}-{k}": f"c{n}-{k + 1}" for k in range(n)}
    links |= {f"t{k}": f"c100-{rng.randrange(100)}" for k in range(50)}
    links |= {f"y{k}": f"y{(k + 1) % 5}" for k in range(5)} | {f"z{k}": f"y{k % 5}" if k % 2 else f"z{k - 1}" for k in range(1, 9)} | {"self": "self"}

    def brute(t):
        steps, seen = 0, set()
        while t in links:
            if t in seen:
                return None, None
            seen.add(t)
            t, steps = links[t], steps + 1
        return t, steps

    rows = list(links.items()) + [("c1-0", "zzz"), (None, "x"), ("x", None)]
    rng.shuffle(rows)
    got = {r.title: (r.final, r.steps) for r in redirects.followed(spark.createDataFrame(rows, "`from` string, `to` string")).collect()}
    assert got == {t: brute(t) for t in links}
    assert redirects.followed(spark.createDataFrame([], "`from` string, `to` string")).count() == 0


def test_seeds_of_a_polity_itself(spark):
    seeds = literal(spark, [("대한제국", "대한제국", 1), ("조선", "x", 2), ("none", "x", 3), ("조선", "y", 4)], "era string, title string, seq int")
    found = literal(spark, [("대한제국", "Q28233", "e", "대한제국"), ("x", "Q1", "e", "X"), ("y", "Q1", "f", "Y")], "requested string, qid string, extract string, title string")
    nodes, edges = redirects.seeded_events(seeds, found)
    assert {(r.id, r.type, r.label) for r in nodes.collect()} == {("wd:Q28233", "event", "대한제국"), ("wd:Q1", "event", "Y"), ("wd:Q28179", "org", "조선")}
    assert {(r.src, r.dst) for r in edges.collect()} == {("wd:Q1", "wd:Q28179")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  <!DOCTYPE html><p>", "not an API"), ("<r><HTML></r>", "not an API"), ("<OpenAPI_ServiceResponse><returnReasonCode> 30 </returnReasonCode></OpenAPI_ServiceResponse>", "key not registered"),
        ("<x><errMsg>SERVICE_ACCESS_DENIED_ERROR</errMsg></x>", "access denied"), ("<x><errMsg>odd</errMsg></x>", "other"), ("<x><errMsg></errMsg></x>", None), ("<r><item/></r>", None), (None, None),
    ],
)
def test_errors_that_come_as_successes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(payload_log.error_class(F.col("t"))).first()[0] == want


def test_log_of_requests(spark):
    bad = "<x><errMsg>odd</errMsg></x>"
    log = [
        ("a", 1, "answer", 200, "old"), ("a", 2, "answer", 200, "new"), ("a", 3, "answer", 200, bad),
        ("b", 1, "answer", 200, "x"), ("b", 2, "invalidate", 0, None), ("b", 3, "answer", 503, None), ("b", 4, "answer", 503, None),
        ("c", 1, "answer", 404, "gone"), ("d", 1, "answer", 0, None), ("d", 2, "answer", 0, None), ("d", 3, "answer", 0, None), ("e", 1, "answer", 200, bad), ("f", 1, "invalidate", 0, None),
    ]
    df = spark.createDataFrame(log, "key string, t int, kind string, status int, text string").withColumn("at", F.timestamp_seconds("t")).drop("t")
    assert {(r.key, r.text) for r in payload_log.served(df).collect()} == {("a", "new")}
    got = {r.key: (r.failures, r.state, r.t) for r in payload_log.due(df).withColumn("t", F.unix_timestamp("next_at")).collect()}
    assert got == {"b": (2, "open", 14), "c": (1, "refused", None), "d": (3, "given_up", None), "e": (1, "refused", None), "f": (0, "open", 1)}


def test_degrees_after_any_batches(spark, tmp_path):
    """Edges come, come again with other values, and go; degrees and counts follow from changed buckets alone."""
    rng = random.Random(2)
    out = GraphStore(spark, str(tmp_path / "g"), 4)
    degree, counts, version = spark.createDataFrame([], "id string, degree long"), spark.createDataFrame([], "metric string, key string, n long"), 0
    fields = "src string, dst string, type string, source string, label string"
    for step in range(4):
        rows = list({(f"a:{rng.randrange(6)}", f"a:{rng.randrange(6)}", rng.choice(["part_of", "related_to"]), "s") for _ in range(9)})
        tx = out.begin()
        if step == 2:
            tx.delete("edges", spark.createDataFrame([(*r, "") for r in rows], fields))
        else:
            tx.merge("edges", spark.createDataFrame([(*r, str(step)) for r in rows], fields))
        now = tx.commit().version
        changed = incremental.changes(out, "edges", version, now)
        degree, counts, version = incremental.degrees(degree, changed), incremental.counts(counts, changed, {"edges": "", "edge_type": "type"}), now
        edges = [(r.src, r.dst, r.type) for r in out.read("edges").collect()]
        want = {}
        for a, b, _ in edges:
            for x in {a, b}:
                want[x] = want.get(x, 0) + 1
        assert {r.id: r.degree for r in degree.collect()} == want
        own = {t: sum(e[2] == t for e in edges) for t in {e[2] for e in edges}}
        assert {(r.metric, r.key): r.n for r in counts.collect()} == {("edge_type", t): n for t, n in own.items()} | {("edges", ""): len(edges)}


def test_signed_rows_are_summed_without_a_shuffle_of_rows(spark, tmp_path):
    """A transaction that merges and deletes folds once; degrees and counts of signed rows are those of the changes."""
    out = GraphStore(spark, str(tmp_path / "g"), 4)
    fields = "src string, dst string, type string, source string, label string"
    rows = [(f"a:{k % 7}", f"a:{k * k % 11}", "part_of", str(k % 3), "x") for k in range(60)] + [("a:1", "a:1", "related_to", "s", "loop")]
    tx = out.begin()
    tx.merge("edges", spark.createDataFrame(rows[:30], fields))
    tx.commit()
    tx = out.begin()
    tx.merge("edges", spark.createDataFrame([(*r[:4], "y") for r in rows[20:]], fields))
    tx.delete("edges", spark.createDataFrame([(*r[:4], "") for r in rows[10:50:3]], fields))
    tx.commit()
    kinds = Counter(n.rpartition("-")[2] for n in out._names("segments"))
    assert kinds == {"whole": 2, "delta": 1, "gone": 1}
    none, keys = spark.createDataFrame([], "id string, degree long"), {"edges": "", "edge_type": "type"}
    start = spark.createDataFrame([], "metric string, key string, n long")
    got = {}
    for of in (incremental.signed, incremental.changes):
        degree = incremental.degrees(incremental.degrees(none, of(out, "edges", 0, 1)), of(out, "edges", 1, 2))
        counts = incremental.counts(incremental.counts(start, of(out, "edges", 0, 1), keys), of(out, "edges", 1, 2), keys)
        got[of] = {tuple(r) for r in degree.collect()}, {tuple(r) for r in counts.collect()}
    edges = {(r.src, r.dst, r.type, r.source) for r in out.read("edges").collect()}
    assert edges == {r[:4] for r in rows} - {r[:4] for r in rows[10:50:3]}
    want = Counter(x for e in edges for x in {e[0], e[1]})
    assert got[incremental.signed] == got[incremental.changes] and got[incremental.signed][0] == set(want.items())
    plan = incremental.degrees(none, incremental.signed(out, "edges", 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "label" not in plan


def test_counts_begin_with_the_stored_version(spark):
    """The view of the tables is computed for each batch, and not again for the counts before it."""
    plan = ingested._counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
