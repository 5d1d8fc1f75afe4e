"""Near-duplicate embeddings by cross-polytope hashing with multiprobe, and exact verification.

Vectors pass three rounds of random signs and a fast Hadamard transform; the largest coordinate and
its sign are one hash value, and a table's bucket is made of a few of them. Every vector is stored
under its own bucket and under the next best ones, so that neighbours split by a close call meet. Within a bucket
pairs are verified by cosine, block by block, and only a spanning forest of the links
leaves the task. Links are then counted inside each component, again in blocks: a group of copies
is never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

THRESHOLD = 0.98
#: Tables, hash values of a bucket, buckets that a vector is stored in by table, and vectors of a block.
TABLES, VALUES, PROBES, BLOCK = 8, 2, 3, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    size = 1
    while size < d:
        x = x.reshape(n, d // (2 * size), 2, size)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        size *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, table_no: int, values: int = VALUES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers by row: the vector's own first, then the next best; columns are probes."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = np.random.default_rng([7, table_no, width]).choice([-1.0, 1.0], (values, 3, width))
    best, loss = [], []
    for v in range(values):
        y = padded
        for r in range(3):
            y = hadamard(y * signs[v, r])
        size = np.abs(y)
        top = np.argpartition(-size, min(probes, width - 1), axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        codes = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        best.append(codes)
        loss.append(size.max(1, keepdims=True) - np.take_along_axis(size, top, 1))
    # All combinations of the values' choices, by their summed loss.
    number, total = best[0].astype(np.int64), loss[0]
    for v in range(1, values):
        number = (number[:, :, None] * (2 * width) + best[v][:, None, :]).reshape(n, -1)
        total = (total[:, :, None] + loss[v][:, None, :]).reshape(n, -1)
    order = np.argsort(total, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(number, order, 1)


def forest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, ids_y: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows of x and those of y (which may be the same)."""
    near = x @ y.T >= threshold
    rows, columns = np.nonzero(near)
    if x is y and len(rows) <= len(x):  # each is near itself alone
        return []
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while (p := parent.get(a, a)) != a:
            parent[a] = parent.get(p, p)
            a = p
        return a

    out = []
    for a, b in _thinned(near, rows, columns, ids, ids_y):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _thinned(near: np.ndarray, rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, ids_y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links enough to connect what ``near`` connects: breadth first over the two sides, each node once."""
    left = np.ones(near.shape[0], bool)
    right = np.ones(near.shape[1], bool)
    for start in np.unique(rows):
        if not left[start]:
            continue
        left[start] = False
        todo = [(0, start)]
        while todo:
            side, at = todo.pop()
            found = np.flatnonzero(near[at] & right) if side == 0 else np.flatnonzero(near[:, at] & left)
            (right if side == 0 else left)[found] = False
            for k in found:
                a, b = (ids[at], ids_y[k]) if side == 0 else (ids[k], ids_y[at])
                if a != b:
                    yield int(a), int(b)
                todo.append((1 - side, k))


def _unit(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of rows sorted by ``key``. Most buckets hold two or three rows, so no group is a call of its own."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if rest is not None:
            b = pa.concat_batches([rest, b])
        if not len(b):
            continue
        code = b.select(key).to_pandas()
        edges = np.flatnonzero((code.to_numpy()[1:] != code.to_numpy()[:-1]).any(1)) + 1
        cuts = [0, *edges.tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                yield b.slice(lo, hi - lo)
        rest = b.slice(cuts[-1])
    if rest is not None and len(rest) > 1:
        yield rest


def _sides(group: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch, bool]:
    """The two blocks of a group, and whether they are one."""
    if group["i"][0].as_py() == group["j"][0].as_py():
        return group, group, True
    side = group["side"].to_numpy()
    return group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1)), False


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key)


def _in_blocks(rows: DataFrame, key: list[str], block: int) -> DataFrame:
    """Rows of every group dealt to pairs of blocks: (key, i, j, side), so that a task holds two blocks at most.

    A group of n rows has ceil(n / block) blocks; a row goes to as many pairs as there are blocks.
    """
    sizes = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = written(sizes.drop("rows"), "embedding-sizes")
    own = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return own.select("*", other).select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """``id_col, n_links, component_id, kept``: one row per vector.

    Only vectors of one label and of one length are compared; those with a null label, null or zero vectors, and vectors
    with null or non-finite components link with nothing and are their own component. Ids should be unique: rows that
    repeat an id come back once each, with the id's links. Null ids link with nothing. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    id_ = F.col(id_col).cast("long")
    rows = vectors.select(id_.alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    largest = F.array_max(F.transform("v", F.abs))
    fit = rows.where("id is not null and label is not null and v is not null").where(F.size("v") > 0).where(~bad).where(largest > 0)
    # By the largest component first, so that squares neither overflow nor vanish.
    fit = fit.withColumn("v", F.transform("v", lambda c: c / largest))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    # Equal directions are one point: groups of exact copies never meet in a bucket.
    fit = written(fit.select("id", F.concat_ws(":", "label", F.size("v")).alias("label"), F.transform("v", lambda c: c / norm).alias("v")), "embedding-unit")
    points = written(fit.groupBy("label", "v").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies")), "embedding-points")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, own in b.groupby(b["v"].map(len)):
                x = _unit(own["v"])
                for t in range(tables):
                    number = buckets(x, t)
                    for k in range(number.shape[1]):
                        yield pd.DataFrame({"id": own["id"].to_numpy(), "label": own["label"].to_numpy(), "bucket": number[:, k] * tables + t})

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, ["label", "bucket", "i", "j"]):
            x, y, same = _sides(group)
            if len(x) and len(y):
                left, ids = _vectors(x["v"]), x["id"].to_numpy()
                out += forest(left, ids, left, ids, threshold) if same else forest(left, ids, _vectors(y["v"]), y["id"].to_numpy(), threshold)
            if len(out) >= 100_000:
                yield pairs(out)
                out = []
        yield pairs(out)

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    stored = written(points.select("id", "label", "v").mapInPandas(hashed, "id long, label string, bucket long"), "embedding-buckets")
    # Only what shares its bucket fetches its vector.
    shared = _in_blocks(stored, ["label", "bucket"], block).join(points.select("id", "label", "v"), ["id", "label"])
    key = ["label", "bucket", "i", "j"]
    links = written(_dealt(shared.select(*key, "side", "id", "v"), key).mapInArrow(linked, "a long, b long").distinct(), "embedding-links")
    groups = written(components(links), "embedding-components")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["component", "i", "j"]):
            x, y, same = _sides(group)
            if not (len(x) and len(y)):
                continue
            near = (_vectors(x["v"]) @ _vectors(y["v"]).T >= threshold).astype(np.int64)
            if same:
                np.fill_diagonal(near, 0)
            ids, n = [x["id"].to_numpy()], [near @ y["copies"].to_numpy()]
            if not same:
                ids.append(y["id"].to_numpy())
                n.append(near.T @ x["copies"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n))], ["id", "n"])

    members = points.join(groups, points["id"] == groups["node"]).select("id", "v", "copies", "component")
    key = ["component", "i", "j"]
    counts = _dealt(_in_blocks(members, ["component"], block), key).mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    point = points.select("id", "copies", "label", "v").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "id", "left")
    point = written(point.select(F.xxhash64("label", "v").alias("h"), "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "embedding-result")
    # Back to every vector through its point.
    found = fit.join(point, (F.xxhash64(fit["label"], fit["v"]) == point["h"]) & (fit["label"] == point["label"]) & (fit["v"] == point["v"])).select(fit["id"].alias("_id"), "n_links", "component_id").distinct()
    out = vectors.select(id_.alias(id_col)).join(found, F.col(id_col) == found["_id"], "left")
    component = F.coalesce("component_id", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

