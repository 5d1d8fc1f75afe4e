"""Queries over payloads, redirects, logs and versions that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, redirects, resolve, store
from ..operators.lineage import shared_path
from ..sources import heritage, payload_log
from ..sources.graphstore import GraphStore
from .registry import _PLACE_SQL, query
from .view import edges, literal, read, sql

# --- heritage: parts as items of a paged registry ----------------------------------------------


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


DISTRICTS = ["", "중구", "경주시", "해운대구", "없는군"]
ERAS = ["조선시대", "통일신라시대", "통일신라시대∼고려시대", ""]
PLACES = ["서울특별시", "경주시", "부산광역시", "중구", "중구", "경상북도"]


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(s, d, "part").withColumns({"k": k, "kdcd": _pick(["11", "12"], k), "ctcd": _pick(["11", "37", "21"], k), "page": F.expr("cast(p_partkey div 600 + 1 as int)")})


def heritage_pages(s: SparkSession, d: str) -> DataFrame:
    """Lists of a hundred items a page, one of them cut off at its second page, all with a page too many; some pages come twice."""
    p, k = _parts(s, d), F.col("k")
    fields = [("ccbaAsno", k), ("ccbaMnm1", F.concat(F.lit(" "), "p_name", F.lit(" "))), ("ccbaMnm2", F.col("p_brand")), ("longitude", F.col("p_retailprice")), ("latitude", F.col("p_size")), ("ccbaCtcdNm", F.when(k % 4 != 0, _pick(["서울특별시", "경상북도", "부산광역시"], k))), ("ccsiName", _pick(DISTRICTS, k)), ("ccmaName", F.when(k % 7 != 0, F.lit("보물"))), ("ccbaAdmin", F.col("p_brand"))]
    item = F.concat(F.lit("<item>"), *(_tag(n, v) for n, v in fields), F.lit("</item>"))
    total = p.groupBy("kdcd", "ctcd").agg(F.count(F.lit(1)).alias("total"), F.max("page").alias("last"))
    pages = p.groupBy("kdcd", "ctcd", "page").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items")).join(total, ["kdcd", "ctcd"])
    text = F.concat(F.lit("<result><totalCnt>"), F.col("total").cast("string"), F.lit("</totalCnt>"), "items", F.when((F.col("kdcd") == "12") & (F.col("ctcd") == "21") & (F.col("page") == 2), "<item>").otherwise("</result>"))
    more = total.select("kdcd", "ctcd", (F.col("last") + 1).alias("page"), F.lit("<result><totalCnt>1</totalCnt><item><ccbaAsno>0</ccbaAsno><ccbaMnm1>never</ccbaMnm1></item></result>").alias("text"))
    pages = pages.select("kdcd", "ctcd", "page", text.alias("text"))
    return pages.union(more).union(pages.where("page % 2 = 1"))


def heritage_details(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    fields = [("content", F.concat("p_name", F.lit(" is "), "p_type")), ("ccbaAsdt", F.when(k % 13 == 0, "1962").otherwise(F.concat(F.lit("19"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("0105")))), ("ccbaQuan", F.lit("1")), ("gcodeName", F.col("p_type")), ("bcodeName", F.lit("")), ("mcodeName", F.col("p_brand")), ("ccceName", _pick(ERAS, k))]
    text = F.concat(F.lit("<result><item>"), *(_tag(n, v) for n, v in fields), F.when(k % 11 == 0, "").otherwise("</item></result>"))
    return _parts(s, d).where("k % 5 <> 3").select("kdcd", "ctcd", k.cast("string").alias("ccbaAsno"), text.alias("text"))


def _ingested(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return heritage.ingest(heritage.listed(heritage_pages(s, d)), heritage.details(heritage_details(s, d)))


_REGION = _pick_sql(["서울특별시", "경상북도", "부산광역시"], "k")
_HERITAGE = f"""WITH p AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '11' ELSE '12' END AS kdcd, {_pick_sql(['11', '37', '21'], 'p_partkey')} AS ctcd FROM part WHERE NOT (p_partkey % 6 = 5 AND p_partkey >= 600)),
 i AS (SELECT *, 'khs:' || kdcd || '-' || ctcd || '-' || k AS id, {_REGION} AS sido, nullif({_pick_sql(DISTRICTS, 'k')}, '') AS sigungu, k % 5 <> 3 AND k % 11 <> 0 AS has, nullif({_pick_sql(ERAS, 'k')}, '') AS era FROM p)"""
_HERITAGE_NODES = """SELECT id, 'heritage' AS type, p_name AS label, 'khs' AS source, CASE WHEN has THEN p_name || ' is ' || p_type END AS description, p_size::DOUBLE AS lat, p_retailprice::DOUBLE AS lon,
 'https://www.heritage.go.kr/heri/cul/culSelectDetail.do?ccbaKdcd=' || kdcd || '&ccbaAsno=' || k || '&ccbaCtcd=' || ctcd AS url,
 CASE WHEN k % 7 <> 0 OR kdcd = '12' THEN '보물' ELSE '국보' END AS designation, CASE WHEN has AND k % 13 <> 0 THEN '19' || lpad(p_size::VARCHAR, 2, '0') || '-01-05' END AS designated_on, CASE WHEN has THEN '["' || p_type || '","' || p_brand || '"]' ELSE '[]' END AS category, NULL::VARCHAR AS sido, NULL::VARCHAR AS sigungu FROM i
 UNION ALL SELECT DISTINCT concat_ws(':', 'kr:place', sido, sigungu), 'place', concat_ws(' ', sido, sigungu), 'khs', NULL, NULL, NULL, NULL, NULL, NULL, NULL, sido, sigungu FROM i
 UNION ALL SELECT DISTINCT 'kr:period:' || era, 'period', era, 'khs', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM i WHERE has AND era IS NOT NULL"""


@query("heritage_nodes", f"{_HERITAGE} {_HERITAGE_NODES}")
def _heritage_nodes(s: SparkSession, d: str) -> DataFrame:
    return _ingested(s, d)[0].select("id", "type", "label", "source", "description", "lat", "lon", "url", *(F.get_json_object("props", f"$.{k}").alias(k) for k in ("designation", "designated_on", "category", "sido", "sigungu")))


query("heritage_edges", f"{_HERITAGE} SELECT id AS src, concat_ws(':', 'kr:place', sido, sigungu) AS dst, 'located_in' AS type FROM i UNION ALL SELECT id, 'kr:period:' || era, 'from_period' FROM i WHERE has AND era IS NOT NULL")(lambda s, d: _ingested(s, d)[1].select("src", "dst", "type"))
query("heritage_aliases", f"{_HERITAGE} SELECT id AS node_id, p_brand AS alias FROM i")(lambda s, d: _ingested(s, d)[2])


@query("heritage_linked", f"{_HERITAGE}, known AS (SELECT {_PLACE_SQL.format('label')} AS name, min(id) AS id FROM (SELECT 'wd:P' || n_nationkey AS id, CASE WHEN n_nationkey < 6 THEN {_pick_sql(PLACES, 'n_nationkey')} ELSE n_name END AS label FROM nation) GROUP BY 1 HAVING count(*) = 1), own AS (SELECT DISTINCT concat_ws(':', 'kr:place', sido, sigungu) AS a, {_PLACE_SQL.format('sigungu')} AS g, {_PLACE_SQL.format('sido')} AS o FROM i) SELECT a, coalesce(x.id, y.id) AS b, 'place_label_exact' AS method FROM own LEFT JOIN known x ON x.name = g LEFT JOIN known y ON y.name = o WHERE coalesce(x.id, y.id) IS NOT NULL UNION ALL SELECT DISTINCT 'kr:period:' || era, CASE era WHEN '조선시대' THEN 'wd:Q28179' ELSE 'wd:Q28456' END, 'period_polity' FROM i WHERE has AND era IN ('조선시대', '통일신라시대')")
def _heritage_linked(s: SparkSession, d: str) -> DataFrame:
    """Places and periods of the ingested registry, linked to nations in the part of known places and to polities."""
    k = F.col("n_nationkey")
    known = read(s, d, "nation").select(F.concat(F.lit("wd:P"), k.cast("string")).alias("id"), F.lit("place").alias("type"), F.when(k < 6, _pick(PLACES, k)).otherwise(F.col("n_name")).alias("label"), F.lit("wd").alias("source"), F.lit("{}").alias("props"))
    polities = literal(s, [(f"wd:{q}", "org", q, "wd", "{}") for q in ("Q28179", "Q28456")], "id string, type string, label string, source string, props string")
    own = _ingested(s, d)[0].select("id", "type", "label", "source", "props").union(known).union(polities)
    return resolve.link_places(own).union(resolve.link_periods(own)).select("a", "b", "method")


# --- redirects: each order leads to its customer's next one ------------------------------------

_CHAIN = "chain AS (SELECT *, 'O' || o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS steps, 'O' || max(o_orderkey) OVER (PARTITION BY o_custkey) AS final, o_custkey % 10 = 0 AS cyclic FROM orders)"
SEED_ERAS = ["고려", "조선", "none", "대한제국"]


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Redirects (from, to); the orders of every tenth customer go round."""
    o = read(s, d, "orders").select("o_custkey", "o_orderkey")
    ends = F.expr("first(o_orderkey) over (partition by o_custkey order by o_orderkey)")
    later = F.expr("lead(o_orderkey) over (partition by o_custkey order by o_orderkey)")
    to = F.coalesce(later, F.when(F.col("o_custkey") % 10 == 0, ends))
    return o.select(F.concat(F.lit("O"), "o_orderkey").alias("from"), F.concat(F.lit("O"), to).alias("to")).where("`to` is not null")


query("redirect_chains", f"WITH {_CHAIN} SELECT title, CASE WHEN NOT cyclic THEN final END AS final, CASE WHEN NOT cyclic THEN steps END AS steps FROM chain WHERE steps > 0 OR cyclic")(lambda s, d: redirects.followed(_chain(s, d)))


def _articles(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Titles in lower case are normalized; the last order of every customer is a page, some without an item or a text."""
    o = read(s, d, "orders")
    title = F.concat(F.lit("O"), "o_orderkey")
    wanted = o.select(F.when(F.col("o_orderkey") % 3 == 0, F.lower(title)).otherwise(title).alias("title"))
    normalized = o.where("o_orderkey % 3 = 0").select(F.lower(title).alias("from"), title.alias("to"))
    qid = F.when(F.col("o_custkey") % 11 == 1, "").when(F.col("o_custkey") % 17 == 3, "Q28179").otherwise(F.concat(F.lit("Q"), (F.col("o_custkey") % 40).cast("string")))
    pages = o.select(title.alias("title"), qid.alias("qid"), F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).otherwise(F.lit(" ")).alias("extract"))
    return redirects.articles(wanted, normalized, _chain(s, d), pages)


_FOUND = f"WITH {_CHAIN}, w AS (SELECT CASE WHEN c.o_orderkey % 3 = 0 THEN lower(c.title) ELSE c.title END AS requested, c.o_orderkey AS seq, c.cyclic OR p.o_custkey % 11 = 1 OR p.o_custkey % 7 = 0 AS missing, CASE WHEN p.o_custkey % 17 = 3 THEN 'Q28179' ELSE 'Q' || p.o_custkey % 40 END AS qid, p.o_orderpriority AS extract, c.final AS title, {_pick_sql(SEED_ERAS, 'c.o_orderkey')} AS era FROM chain c JOIN chain p ON p.title = c.final)"
query("articles_found", f"{_FOUND} SELECT requested, qid, extract, title FROM w WHERE NOT missing")(lambda s, d: _articles(s, d)[0])
query("articles_missing", f"{_FOUND} SELECT requested FROM w WHERE missing")(lambda s, d: _articles(s, d)[1])


def _seeded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    title = F.concat(F.lit("O"), "o_orderkey")
    seeds = read(s, d, "orders").select(_pick(SEED_ERAS, k).alias("era"), F.when(k % 3 == 0, F.lower(title)).otherwise(title).alias("title"), k.alias("seq"))
    return redirects.seeded_events(seeds, _articles(s, d)[0])


_SEEDED = f"{_FOUND}, r AS (SELECT *, 'wd:' || qid AS id, CASE era WHEN '고려' THEN 'wd:Q28208' WHEN '조선' THEN 'wd:Q28179' WHEN '대한제국' THEN 'wd:Q28233' END AS polity FROM w WHERE NOT missing)"
query("seeded_nodes", f"{_SEEDED}, e AS (SELECT id, arg_max(title, seq) AS label, arg_max(extract, seq) AS description, arg_max(era, seq) AS era FROM r GROUP BY id) SELECT id, 'event' AS type, label, description, era AS seed_era, 'https://ko.wikipedia.org/wiki/' || label AS kowiki_url FROM e UNION ALL SELECT DISTINCT polity, 'org', era, NULL, NULL, NULL FROM r WHERE polity IS NOT NULL AND polity <> id AND polity NOT IN (SELECT id FROM e)")(
    lambda s, d: _seeded(s, d)[0].select("id", "type", "label", "description", *(F.get_json_object("props", f"$.{k}").alias(k) for k in ("seed_era", "kowiki_url")))
)
query("seeded_edges", f"{_SEEDED} SELECT DISTINCT id AS src, polity AS dst, 'from_period' AS type, 'kowiki' AS source FROM r WHERE polity <> id")(lambda s, d: _seeded(s, d)[1])

# --- the log of requests: events as attempts ---------------------------------------------------

ERROR = "<x><errMsg>NO_OPENAPI_SERVICE_ERROR</errMsg></x>"


def _log(s: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", F.element_at(F.array(F.lit(503), F.lit(404), F.lit(0)), (k % 3 + 1).cast("int"))).otherwise(200)
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (k % 50).cast("string"))
    return read(s, d, "events").select(key.alias("key"), F.col("ts").cast("timestamp").alias("at"), F.when((kind == "signup") & (k % 2 == 0), "invalidate").otherwise("answer").alias("kind"), status.alias("status"), F.when((kind == "view") & (k % 2 == 0), ERROR).when(kind != "error", F.col("props")).alias("text"))


_LOG = f"WITH log AS (SELECT 'u' || user_id || '-' || event_id % 50 AS key, ts AS t, event_type = 'signup' AND event_id % 2 = 0 AS gone, CASE WHEN event_type <> 'error' THEN 200 ELSE [503, 404, 0][event_id % 3 + 1] END AS status, event_type = 'view' AND event_id % 2 = 0 AS bad, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN '{ERROR}' ELSE props END AS text FROM events), l AS (SELECT *, NOT gone AND status = 200 AND NOT bad AS good FROM log), k AS (SELECT key, max(t) FILTER (WHERE gone) AS gone_at, max(t) FILTER (WHERE good) AS good_at, max(t) FILTER (WHERE gone OR good) AS since, max(t) AS seen FROM l GROUP BY key)"
query("payload_served", f"{_LOG} SELECT key, l.text FROM k JOIN l USING (key) WHERE l.good AND l.t = good_at AND (gone_at IS NULL OR good_at > gone_at)")(lambda s, d: payload_log.served(_log(s, d)).select("key", "text"))
query("payload_due", f"{_LOG}, f AS (SELECT key, count(*) AS failures, max(l.t) AS last, arg_max(status, l.t) AS status, arg_max(bad, l.t) AS bad FROM l JOIN k USING (key) WHERE NOT gone AND NOT good AND (since IS NULL OR l.t > since) GROUP BY key), u AS (SELECT k.key, coalesce(failures, 0) AS failures, CASE WHEN failures IS NULL THEN 'open' WHEN status = 404 OR bad THEN 'refused' WHEN failures >= 3 THEN 'given_up' ELSE 'open' END AS state, CASE WHEN failures IS NULL THEN seen ELSE last + to_seconds((CASE WHEN status = 503 THEN 5 ELSE 1 END) * 2 ** (failures - 1)) END AS next FROM k LEFT JOIN f USING (key) WHERE good_at IS NULL OR good_at <= gone_at) SELECT key, failures, state, CASE WHEN state = 'open' THEN strftime(next, '%Y-%m-%d %H:%M:%S') END AS next_at FROM u")(
    lambda s, d: payload_log.due(_log(s, d)).withColumn("next_at", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss"))
)

# --- degrees and statistics from what changed --------------------------------------------------


def _versions(s: SparkSession, d: str) -> tuple[GraphStore, int, int]:
    """Edges in two versions: first without those of every third customer or order, then with these and without sevenths."""
    out, e = GraphStore(s, shared_path(s, "versions"), 16), edges(s, d)
    number = F.substring_index("src", ":", -1).cast("long")
    tx = out.begin()
    tx.merge("edges", e.where(number % 3 != 0))
    one = tx.commit()
    tx = out.begin()
    tx.merge("edges", e.where(number % 3 == 0))
    tx.delete("edges", e.where(number % 7 == 0))
    return out, one.version, tx.commit().version


def _degrees(s: SparkSession, d: str) -> DataFrame:
    out, one, two = _versions(s, d)
    before = incremental.degrees(s.createDataFrame([], "id string, degree long"), incremental.signed(out, "edges", 0, one))
    return incremental.degrees(before, incremental.signed(out, "edges", one, two))


def _counts(s: SparkSession, d: str) -> DataFrame:
    out, one, two = _versions(s, d)
    keys = {"edge_type": "type", "edges": ""}
    before = incremental.counts(s.createDataFrame([], "metric string, key string, n long"), incremental.signed(out, "edges", 0, one), keys)
    return incremental.counts(before, incremental.signed(out, "edges", one, two), keys)


_LEFT = "left_ AS (SELECT * FROM edges WHERE split_part(src, ':', 2)::BIGINT % 7 <> 0)"
query("degree_incremental", sql(f", {_LEFT} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM left_ UNION ALL SELECT dst FROM left_ WHERE src <> dst) GROUP BY id"))(_degrees)
query("counts_incremental", sql(f", {_LEFT} SELECT 'edge_type' AS metric, type AS key, count(*) AS n FROM left_ GROUP BY type UNION ALL SELECT 'edges', '', count(*) FROM left_"))(_counts)
