"""A Merkle manifest of a table: 16-ary trees of every group, a tree over the groups, and a proof for every row.

Leaves are numbered inside their group by one range sort. Every 16**3 consecutive nodes of one level are an aligned block, the unit
of all work: a block's root is built from its nodes alone, block roots are the nodes of the next, 4096 times smaller, table, and
so on until each group has one node. Proofs come back down the same tables: a block gets the path above it once, and walks its own nodes
by fractal traversal, which keeps for every level the run of siblings in use ("existing") and the next one, half built ("desired").
So no task holds more than a block, however many rows one group has, and long paths are never shuffled by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, release, table, written

ARITY, LEVELS = 16, 3

_PATH = "array<struct<left:string,right:string>>"
_ABOVE = f"grp string, idx long, sub string, path {_PATH}"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value: no two rows of fields give the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


class Growing:
    """The run of up to 16 nodes of one level, built from one leaf after the other with a stack of partial runs below it."""

    def __init__(self, leaves: list[str], level: int, start: int) -> None:
        self.leaves, self.level, self.at = leaves, level, start
        self.end = min(start + ARITY ** (level + 1), len(leaves))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def feed(self) -> None:
        """Take in the next leaf, if there is one; after the last one close what is not full."""
        if self.at >= self.end:
            return
        self._push(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for k in range(self.level):
                if self.stack[k]:
                    self._close(k)

    def _push(self, k: int, node: str) -> None:
        self.stack[k].append(node)
        if k < self.level and len(self.stack[k]) == ARITY:
            self._close(k)

    def _close(self, k: int) -> None:
        run, self.stack[k] = self.stack[k], []
        self._push(k + 1, h("".join(run)))

    def run(self) -> list[str]:
        while self.at < self.end:
            self.feed()
        return self.stack[self.level]


def walk(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """Of every leaf in turn: what stands left and right of its ancestors in their runs, level by level.

    Each step takes one leaf into the desired run of every level, which is whole just when the existing one has been used up.
    """
    existing = [Growing(leaves, k, 0).run() for k in range(levels)]
    desired = [Growing(leaves, k, ARITY ** (k + 1)) for k in range(levels)]
    for i in range(len(leaves)):
        path = []
        for k in range(levels):
            at = i // ARITY**k % ARITY
            path.append(("".join(existing[k][:at]), "".join(existing[k][at + 1 :])))
        yield path
        for k in range(levels):
            desired[k].feed()
            if (i + 1) % ARITY ** (k + 1) == 0:
                existing[k], desired[k] = desired[k].run(), Growing(leaves, k, i + 1 + ARITY ** (k + 1))


def levels_of(total: int, levels: int) -> int:
    """Levels that a block of a group with so many nodes folds: all, or as many as leave one node."""
    n = 0
    while total > 1 and n < levels:
        total, n = -(-total // ARITY), n + 1
    return n


def folded(node: str, path: list) -> str:
    for left, right in path:
        node = h(left + node + right)
    return node


def root_of(leaves: list[str], levels: int) -> str:
    return Growing(leaves, levels, 0).run()[0] if levels else leaves[0]


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number ``idx`` in their group (``grp``) by ``order``, and the group's ``total``.

    A range sort writes each partition with rising numbers; only the counts of (group, partition) are added up.
    """
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    numbered = written(ranged.withColumn("_n", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("_p", F.shiftright("_n", 33))
    counts = written(numbered.groupBy("grp", "_p").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_count")), f"{name}-counts")
    before = F.expr("sum(_count) over (partition by grp order by _p rows between unbounded preceding and current row) - _count")
    offsets = counts.select("grp", "_p", "_first", before.alias("_before"), F.expr("sum(_count) over (partition by grp)").alias("total"))
    return numbered.join(offsets, ["grp", "_p"]).withColumn("idx", F.col("_n") - F.col("_first") + F.col("_before")).drop("_n", "_p", "_first", "_before")


def block_roots(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """``grp, idx, total, node``: the roots of the aligned blocks of nodes (grp, idx, total, node)."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        release()
        total = int(block["total"].iloc[0])
        root = root_of(block.sort_values("idx")["node"].tolist(), levels_of(total, levels))
        return pd.DataFrame([(key[0], key[1], -(-total // ARITY**levels), root)], columns=["grp", "idx", "total", "node"])

    blocks = nodes.select("grp", block_of(levels).alias("block"), "idx", "total", "node")
    return written(blocks.groupBy("grp", "block").applyInPandas(run, "grp string, idx long, total long, node string"), name)


def block_of(levels: int) -> Column:
    return F.expr(f"idx div {ARITY**levels}")


def towers(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, and so on, up to one node for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(block_roots(out[-1], levels, f"{name}-roots"))
    return out


def block_paths(nodes: DataFrame, above: DataFrame, levels: int, name: str) -> DataFrame:
    """``grp, idx, sub, path`` and ``key``: of every node the path that leads from it up, given the path above its block.

    ``sub``, the root of the node's own group, is handed down.
    """

    def run(key: tuple, block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        release()
        block = block.sort_values("idx")
        leaves, top = block["node"].tolist(), [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in up["path"].iloc[0]]
        steps = walk(leaves, levels_of(int(block["total"].iloc[0]), levels))
        paths = [[{"left": a, "right": b} for a, b in [*p, *top]] for p in steps]
        return pd.DataFrame({"grp": key[0], "idx": block["idx"], "sub": up["sub"].iloc[0], "path": paths, "key": block["key"]})

    keyed = nodes if "key" in nodes.columns else nodes.withColumn("key", F.lit(None).cast("string"))
    blocks = keyed.select("grp", block_of(levels).alias("block"), "idx", "total", "node", "key")
    both = blocks.groupBy("grp", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("grp", "block"))
    return written(both.applyInPandas(run, f"{_ABOVE}, key string"), name)


def descended(tower: list[DataFrame], above: DataFrame, levels: int, name: str) -> DataFrame:
    """The paths of the nodes of the first of these tables, given those above the last."""
    for nodes in reversed(tower):
        above = block_paths(nodes, above, levels, f"{name}-paths")
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tamper: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the hash of the row's fields, null ones as ``-``; leaves ascend by id in their group, null ids first and repeated ids
    by their leaves, so that rows that repeat in full stand side by side. Null groups are one group, the first; others follow by their
    bytes. ``tamper`` (by default no row) tells whose text is lower-cased (A-Z) before its root is recomputed with the true
    siblings. A block has ``levels`` levels. A group of one row is its own subroot, one group's subroot is the root. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    lowered = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_hash(*(lowered if c == text_col else F.col(c) for c in fields))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))  # null first, else by bytes
    kind = docs.schema[id_col].dataType.simpleString()
    leaves = docs.select(group.alias("grp"), F.col(id_col).alias("id"), leaf_hash(*fields_of(fields)).alias("node"), F.when(F.lit(False) if tamper is None else tamper, tampered).alias("other"))
    rows = written(placed(written(leaves, "merkle-leaves"), ["id", "node"], "merkle"), "merkle-placed")
    tower = towers(rows.select("grp", "idx", "total", "node"), levels, "merkle")
    if len(tower) == 1:  # no group has two rows: each leaf is a block
        tower.append(block_roots(tower[0], levels, "merkle-roots"))

    groups = written(placed(tower[-1].select(F.lit("").alias("grp"), F.col("grp").alias("key"), "node"), ["key"], "merkle-groups"), "merkle-groups")
    top = towers(groups.select("grp", "idx", "total", "node"), levels, "merkle-groups")
    top[0] = groups
    found = top[-1].select("node").first()
    root = found[0] if found else ""
    start = top[-1].select("grp", "idx", F.lit("").alias("sub"), F.array().cast(_PATH).alias("path"))
    paths = descended(top[:-1], start, levels, "merkle-groups") if len(top) > 1 else groups.select("idx", F.array().cast(_PATH).alias("path"), "key")
    subroots = tower[-1].select(F.col("grp").alias("key"), F.col("node").alias("sub"))
    above = paths.select("key", "path").join(subroots, "key").select(F.col("key").alias("grp"), F.lit(0).cast("long").alias("idx"), "sub", "path")
    above = descended(tower[1:-1], above, levels, "merkle").select("grp", "idx", "sub", "path")

    def prove(key: tuple, block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        release()
        block = block.sort_values("idx")
        top = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in up["path"].iloc[0]]
        proofs, folds = [], []
        for path, node, other in zip(walk(block["node"].tolist(), levels_of(int(block["total"].iloc[0]), levels)), block["node"], block["other"], strict=True):
            whole = [*path, *top]
            proofs.append(h("".join(a + b for a, b in whole)))
            folds.append(folded(other if isinstance(other, str) else node, whole))
        out = pd.DataFrame({id_col: block["id"], "leaf": block["node"], "subroot": up["sub"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folds})
        return out.assign(verified=out["folded_root"] == root)

    blocks = rows.withColumn("block", block_of(levels)).groupBy("grp", "block")
    both = blocks.cogroup(above.withColumnRenamed("idx", "block").groupBy("grp", "block"))
    return both.applyInPandas(prove, f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def fields_of(names: tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in names]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tamper=id_remainder(F.col("doc_id"), 5) == 0)


def _sql(inner: int = 6, outer: int = 3) -> str:
    """``inner`` levels are enough for 16**6 rows of one source, ``outer`` for 16**3 sources."""
    def bytes_of(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(bytes_of(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    ctes = [
        "bits(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8)",
        "crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)",
        "docs AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c // 256)), 4294967295::BIGINT) % 5 = 0 AS bad FROM documents, crc)",
        f"l0 AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN bad THEN {leaf('translate(text, ' + repr('ABCDEFGHIJKLMNOPQRSTUVWXYZ') + ', ' + repr('abcdefghijklmnopqrstuvwxyz') + ')')} END AS other FROM docs)",
        "n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node FROM l0)",
    ]
    prev = "SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM n0"

    def level(tag: str, prev: str) -> str:
        ctes.append(f"t{tag} AS MATERIALIZED ({prev})")
        ctes.append(f"r{tag} AS MATERIALIZED (SELECT g, i // 16 AS j, list(node ORDER BY i) AS run FROM t{tag} WHERE n > 1 GROUP BY g, i // 16)")
        return f"SELECT g, j AS i, node, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, j, sha256(array_to_string(run, '')) AS node FROM r{tag} UNION ALL SELECT g, i, node FROM t{tag} WHERE n = 1)"

    for k in range(inner):
        prev = level(f"i{k}", prev)
    ctes.append(f"sub AS MATERIALIZED (SELECT g AS s, node, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM ({prev}))")
    prev = "SELECT '' AS g, i, node, count(*) OVER () AS n FROM sub"
    for k in range(outer):
        prev = level(f"o{k}", prev)
    ctes.append(f"top AS (SELECT node AS root FROM ({prev}))")
    step = "SELECT p.doc_id, p.leaf, p.g, p.sub, {keep}p.{i} // (CASE WHEN run IS NULL THEN 1 ELSE 16 END) AS {i}, p.proof || CASE WHEN run IS NULL THEN '' ELSE array_to_string(run[1:{at}], '') || array_to_string(run[{at} + 2:], '') END AS proof, CASE WHEN run IS NULL THEN p.node ELSE sha256(array_to_string(run[1:{at}], '') || p.node || array_to_string(run[{at} + 2:], '')) END AS node FROM {p} p LEFT JOIN {r} r ON r.g = {key} AND r.j = p.{i} // 16"
    ctes.append("p0 AS MATERIALIZED (SELECT n0.doc_id, leaf, g, sub.node AS sub, sub.i AS gi, n0.i AS i, '' AS proof, coalesce(other, leaf) AS node FROM n0 JOIN sub ON sub.s = g)")
    n = 0
    for k in range(inner):
        ctes.append(f"p{n + 1} AS MATERIALIZED (" + step.format(i="i", at="(p.i % 16)", keep="p.gi, ", p=f"p{n}", r=f"ri{k}", key="p.g") + ")")
        n += 1
    for k in range(outer):
        ctes.append(f"p{n + 1} AS MATERIALIZED (" + step.format(i="gi", at="(p.gi % 16)", keep="", p=f"p{n}", r=f"ro{k}", key="''") + ")")
        n += 1
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, sub AS subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM p{n}, top"


SQL = _sql()
