"""The star schema seen as a graph, in DataFrames and in SQL, and literal tables for both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ontology import EDGE_FIELDS, NODE_FIELDS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shaped(df: DataFrame, fields: str) -> DataFrame:
    """``df`` with all fields of a table, missing ones null; confidence 1 and props {} by default."""
    default = {"confidence": F.lit(1.0), "props": F.lit("{}")}
    out = []
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.append((F.col(name) if name in df.columns else default.get(name, F.lit(None))).cast(kind).alias(name))
    return df.select(*out)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(table: str, prefix: str, key: str, label: object, kind: str, source: str, **more: object) -> DataFrame:
        t = read(spark, d, table)
        return _shaped(t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), label.alias("label"), F.lit(source).alias("source"), *(v.alias(k) for k, v in more.items())), NODE_FIELDS)

    parts = [
        of("customer", "c:", "c_custkey", F.col("c_name"), "person", "cust", props=F.concat(F.lit('{"polity":"'), "c_mktsegment", F.lit('"}'))),
        of("supplier", "s:", "s_suppkey", F.col("s_name"), "org", "supp"),
        of("part", "p:", "p_partkey", F.col("p_name"), "artwork", "part"),
        of("orders", "o:", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "event", "ord", start_date=F.date_format("o_orderdate", "yyyy-MM-dd"), props=F.when(F.col("o_orderkey") % 100 == 0, '{"seed_era":"BUILDING"}').otherwise("{}")),
        of("nation", "n:", "n_nationkey", F.col("n_name"), "place", "nat"),
        of("region", "r:", "r_regionkey", F.col("r_name"), "place", "reg"),
        of("region", "z:", "r_regionkey", F.concat("r_name", F.lit(" alone")), "place", "reg"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    def of(t: DataFrame, src: tuple[str, str], dst: tuple[str, str], kind: str, source: object, label: object = None) -> DataFrame:
        a, b = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (src, dst))
        return _shaped(t.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), source.alias("source"), *([label.alias("label")] if label is not None else [])), EDGE_FIELDS)

    orders, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    customers = read(spark, d, "customer")
    parts = [
        of(orders, ("c:", "o_custkey"), ("o:", "o_orderkey"), "participated_in", F.lit("ord"), F.col("o_orderstatus")),
        of(customers, ("c:", "c_custkey"), ("n:", "c_nationkey"), "born_in", F.lit("cust")),
        of(read(spark, d, "nation"), ("n:", "n_nationkey"), ("r:", "n_regionkey"), "located_in", F.lit("nat")),
        of(items.select("l_suppkey", "l_partkey").distinct(), ("s:", "l_suppkey"), ("p:", "l_partkey"), "created", F.lit("li")),
        of(items.select("l_orderkey", "l_partkey", "l_returnflag").distinct(), ("o:", "l_orderkey"), ("p:", "l_partkey"), "related_to", F.col("l_returnflag")),
        of(orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"), ("o:", "o_orderkey"), ("n:", "c_nationkey"), "occurred_at", F.lit("ord")),
        of(orders.where("o_orderkey % 50 = 0").withColumn("era", F.lit(1)), ("o:", "o_orderkey"), ("s:", "era"), "from_period", F.lit("ord")),
        of(orders.where("o_orderkey % 51 = 0").withColumn("era", F.lit(2)), ("o:", "o_orderkey"), ("s:", "era"), "from_period", F.lit("ord")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def same_as(spark: SparkSession, d: str) -> DataFrame:
    """Every third nation is the same as a node of another source, which is missing; two suppliers are the same as other nodes."""
    k = F.col("n_nationkey").cast("string")
    return read(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n:"), k).alias("a"), F.concat(F.lit("x:"), k).alias("b"), F.lit("name").alias("method"), F.lit(0.9).alias("score")).union(literal(spark, [("s:2", "s:1", "name", 0.9), ("s:3", "c:1", "name", 0.9)], "a string, b string, method string, score double"))


GRAPH = """
nodes AS (
  SELECT 'c:' || c_custkey AS id, 'person' AS type, c_name AS label, 'cust' AS source, NULL::VARCHAR AS start_date, '{"polity":"' || c_mktsegment || '"}' AS props FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'org', s_name, 'supp', NULL, '{}' FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'artwork', p_name, 'part', NULL, '{}' FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'event', 'order ' || o_orderkey, 'ord', strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 100 = 0 THEN '{"seed_era":"BUILDING"}' ELSE '{}' END FROM orders
  UNION ALL SELECT 'n:' || n_nationkey, 'place', n_name, 'nat', NULL, '{}' FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'place', r_name, 'reg', NULL, '{}' FROM region
  UNION ALL SELECT 'z:' || r_regionkey, 'place', r_name || ' alone', 'reg', NULL, '{}' FROM region
), edges AS (
  SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'participated_in' AS type, 'ord' AS source, o_orderstatus AS label FROM orders
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'born_in', 'cust', NULL FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'located_in', 'nat', NULL FROM nation
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'created', 'li', NULL FROM lineitem
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'related_to', l_returnflag, NULL FROM lineitem
  UNION ALL SELECT 'o:' || o_orderkey, 'n:' || c_nationkey, 'occurred_at', 'ord', NULL FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'o:' || o_orderkey, 's:1', 'from_period', 'ord', NULL FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL SELECT 'o:' || o_orderkey, 's:2', 'from_period', 'ord', NULL FROM orders WHERE o_orderkey % 51 = 0
), same_as AS (
  SELECT 'n:' || n_nationkey AS a, 'x:' || n_nationkey AS b, 'name' AS method, 0.9::DOUBLE AS score FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT * FROM (VALUES ('s:2', 's:1', 'name', 0.9::DOUBLE), ('s:3', 'c:1', 'name', 0.9::DOUBLE)) AS v
), inc AS (
  SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst
), links AS (
  SELECT id, other FROM inc UNION ALL SELECT a, b FROM same_as UNION ALL SELECT b, a FROM same_as
)
"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {GRAPH}{body}"


def literal(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    return spark.createDataFrame(rows, fields)


def _cells(rows: list[tuple], fields: str) -> Column:
    """The rows as one array of structs; a table's rows are made of it without a join."""
    names, types = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    return F.array(*(F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(t).alias(n) for n, t, v in zip(names, types, r, strict=True))) for r in rows))


def copies(spark: SparkSession, d: str, fixture: tuple, own: tuple[str, ...] = ()) -> DataFrame:
    """A small table once for every supplier; the values ``own`` get the supplier's number, so each has entities of its own."""
    out = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("_k"), F.explode(_cells(*fixture)).alias("_r")).select("_k", "_r.*")
    for name, kind in out.dtypes:
        if kind == "string" and name != "_k" and own:
            out = out.withColumn(name, F.when(F.col(name).isin(*own), F.concat(name, F.lit("-"), "_k")).otherwise(F.col(name)))
    return out


def copies_sql(fixture: tuple, own: tuple[str, ...] = ()) -> str:
    listed = ", ".join(f"'{x}'" for x in own)
    columns = [f"CASE WHEN {n} IN ({listed}) THEN {n} || '-' || s_suppkey ELSE {n} END AS {n}" if t == "string" and own else n for n, t in (f.split(" ") for f in fixture[1].split(", "))]
    return f"(SELECT s_suppkey::VARCHAR AS _k, {', '.join(columns)} FROM supplier, {values(*fixture)})"


def spread(spark: SparkSession, d: str, fixture: tuple, table: str, key: str, filled: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """``_k`` and one row of a small table for every row of a given one, by its key; marks in its texts are filled with what the row holds (mark, Spark's expression, SQL's)."""
    n = len(fixture[0])
    out = read(spark, d, table).select(F.col(key).alias("_k"), F.element_at(_cells(*fixture), (F.col(key) % n + 1).cast("int")).alias("_r"), *(F.expr(v).cast("string").alias(f"_f{i}") for i, (_, v, _) in enumerate(filled)))
    out = out.select("_k", "_r.*", *(f"_f{i}" for i in range(len(filled))))
    for name, kind in out.dtypes:
        if kind == "string" and not name.startswith("_"):
            for i, (mark, _, _) in enumerate(filled):
                out = out.withColumn(name, F.replace(F.col(name), F.lit(mark), F.col(f"_f{i}")))
    return out.drop(*(f"_f{i}" for i in range(len(filled))))


def spread_sql(fixture: tuple, table: str, key: str, filled: tuple[tuple[str, str, str], ...] = ()) -> str:
    columns = []
    for n, t in (f.split(" ") for f in fixture[1].split(", ")):
        x = f"v.{n}"
        for i, (mark, _, _) in enumerate(filled if t == "string" else ()):
            x = f"replace({x}, '{mark}', b._f{i})"
        columns.append(f"{x} AS {n}")
    fills = "".join(f", ({by})::VARCHAR AS _f{i}" for i, (_, _, by) in enumerate(filled))
    numbered = values([(i, *r) for i, r in enumerate(fixture[0])], "i long, " + fixture[1])
    return f"(SELECT b._k, {', '.join(columns)} FROM (SELECT {key} AS _k{fills} FROM {table}) AS b JOIN {numbered} AS v ON v.i = b._k % {len(fixture[0])})"


def values(rows: list[tuple], fields: str) -> str:
    """The same rows as an SQL sub-select."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]"}

    def cell(v: object, kind: str) -> str:
        if v is None:
            return f"NULL::{kind}"
        if isinstance(v, list):
            return "[" + ", ".join(cell(x, "VARCHAR") for x in v) + "]::VARCHAR[]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::{kind}"

    names, types = zip(*(f.split(" ") for f in fields.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(cell(v, kinds[t]) for v, t in zip(r, types, strict=True)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"
