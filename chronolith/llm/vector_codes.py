"""Vector code compression: product codes by weighted Lloyd iterations over distinct integer parts.

Components become integers, vectors are cut into equal consecutive parts, and equal parts of one position become one row with
a weight. Lloyd's iterations run over these distinct rows; of each round only the sums of every codebook entry reach the driver
(parts x entries x components of a part, whatever the table's size). Codes and errors are then joined back to the vectors' parts.
Parts that many vectors share (at least one in THOUSAND of them, so at most THOUSAND for each position) are joined by broadcast,
all others by a plain shuffle, in which no key then is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, written

#: A part shared by one in so many vectors is hot.
THOUSAND = 1000
#: Integers of a larger absolute value saturate there; up to NARROW, sums of squares cannot overflow 64 bits.
WIDEST, NARROW = 1 << 62, 1 << 25
#: Errors of one part saturate there, so that the sum over a vector's parts fits.
MOST = (1 << 63) // 1024

_SUMS = "part int, entry int, j int, n long, high long, low long"


def finite(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector: Column, scale: int) -> Column:
    bound = float(WIDEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(bound)), F.lit(-bound))))


def pack(part: np.ndarray) -> bytes:
    """Integers as bytes, two for each if all fit and else eight: equal parts have equal bytes."""
    short = part.astype("<i2")
    return short.tobytes() if (short == part).all() else part.astype("<i8").tobytes()


def unpack(keys: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(keys), width), np.int64)
    sizes = np.array([len(k) for k in keys])
    for kind in ("<i2", "<i8"):
        own = np.flatnonzero(sizes == width * int(kind[2]))
        if width and len(own):
            out[own] = np.frombuffer(b"".join(keys[i] for i in own), kind).reshape(-1, width)
    return out


def packed_parts(parts: int) -> Callable:
    """Vectors of integers as ``parts`` packed parts; where the length is no multiple, zeros are appended."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            keys = []
            for v in b.pop("ints"):
                width = -(-len(v) // parts)
                whole = np.zeros(width * parts, np.int64)
                whole[: len(v)] = v
                keys.append([pack(p) for p in whole.reshape(parts, width)])
            yield b.assign(keys=keys)

    return run


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row, ties to the lower index, and its squared distance; exact for any integers."""
    if max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)) > NARROW or rows.shape[1] > 2048:
        rows, book = rows.astype(object), book.astype(object)
    best, code = None, np.zeros(len(rows), np.int64)
    for k, entry in enumerate(book):
        d = ((rows - entry) ** 2).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), np.int64)
        if best is None:
            best = d
        else:
            less = d < best
            best, code = np.where(less, d, best), np.where(less, k, code)
    return code, best


def by_part(batch: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``part``, the rows of the batch that belong to it, and their integers."""
    part, keys = batch["part"].to_numpy(), batch["key"].tolist()
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, unpack([bytes(keys[i]) for i in at], width)


def lloyd_sums(books: list[np.ndarray], width: int) -> Callable:
    """Weighted sums of the rows nearest to every entry: one row for each entry and component of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            weight = b["n"].to_numpy()
            for p, at, rows in by_part(b, width):
                code, _ = nearest(rows, books[p])
                for k in np.unique(code):
                    own = code == k
                    w = weight[at][own]
                    x = rows[own]
                    # Halves of 31 bits: neither sum overflows, whatever the integers.
                    high, low = (x >> 31).astype(object), (x & (2**31 - 1)).astype(object)
                    if np.abs(x).max(initial=0) <= NARROW and w.sum() < 1 << 36:
                        high, low = np.zeros(width, np.int64), w @ x
                    else:
                        high, low = (high * w[:, None]).sum(axis=0), (low * w[:, None]).sum(axis=0)
                    held = total.setdefault((p, int(k)), [0, [0] * width])
                    held[0] += int(w.sum())
                    held[1] = [s + (int(h) << 31) + int(v) for s, h, v in zip(held[1], high, low, strict=True)]
        rows = [(p, k, j, n, s >> 31, s & (2**31 - 1)) for (p, k), (n, sums) in total.items() for j, s in enumerate(sums)]
        if rows:
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _SUMS.split(", ")])

    return run


def coded(books: list[np.ndarray], width: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            codes, errors = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for p, at, rows in by_part(b, width):
                code, error = nearest(rows, books[p])
                codes[at], errors[at] = code, np.minimum(error, MOST).astype(np.int64)
            yield b.assign(code=codes, part_error=errors)[["part", "key", "n", "code", "part_error"]]

    return run


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``id_col, code, error, label_error`` of every vector kept, and the codebooks by part and entry.

    Rows whose vector is null, or holds null or non-finite components, are dropped, and so are vectors of another length than
    that of the smallest id kept. A length that is no multiple of ``parts`` is filled with zeros. Codebooks start as the parts of
    the ``entries`` smallest ids (ties by their integers, null ids last); with fewer vectors there are fewer entries. Repeated
    rows count as often as they come and all come back; null labels are one label. Integers beyond 2**62, and errors beyond
    what a long holds, saturate. An empty table gives an empty result and no codebooks; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(F.col(vector_col), scale).alias("ints"))
    kind = kept.schema["label"].dataType.simpleString()
    rows = kept.withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("ints"))
    # Once written, the numbers of rows are fixed.
    rows = written(rows.select("row", "id", "label", "dims", "ints").mapInPandas(packed_parts(parts), f"row long, id {kept.schema['id'].dataType.simpleString()}, label {kind}, dims int, keys array<binary>"), "vector-parts")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "keys", "dims").limit(entries).select("dims", "keys").collect()
    if not first:
        none = rows.limit(0)
        return none.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    dims = first[0]["dims"]
    rows = rows.where(F.col("dims") == dims)
    width = -(-dims // parts)
    first = [r for r in first if r["dims"] == dims] if all(r["dims"] == dims for r in first) else rows.orderBy(F.col("id").asc_nulls_last(), "keys").limit(entries).select("dims", "keys").collect()
    books = [unpack([bytes(r["keys"][p]) for r in first], width) for p in range(parts)]

    split = rows.select("row", "id", "label", F.posexplode("keys").alias("part", "key"))
    distinct = written(split.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "vector-distinct")
    for _ in range(rounds):
        sums = distinct.mapInPandas(lloyd_sums(books, width), _SUMS).groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
        books = [b.copy() for b in books]
        for r in sums.collect():
            books[r.part][r.entry, r.j] = ((r.high << 31) + r.low) // r.n
    codes = written(distinct.mapInPandas(coded(books, width), "part int, key binary, n long, code int, part_error long"), "vector-codes")

    many = rows.count() / THOUSAND
    hot, rest = codes.where(F.col("n") >= many).drop("n"), codes.where(F.col("n") < many).drop("n")
    on = ["part", "key"]
    joined = split.join(F.broadcast(hot), on).unionByName(split.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda c: F.lpad(F.lower(F.hex(c["code"])), 2, "0")), "")
    each = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("label").alias("label"), digits.alias("code"), F.sum("part_error").alias("error"))
    each = written(each.drop("row"), "vector-errors")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    labels = written(each.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "vector-labels")
    out = each.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), [b.tolist() for b in books]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    digits = ",".join(str(x) for book in books for entry in book for x in entry)
    return found.withColumn("codebooks_sha256", F.lit(hashlib.sha256(digits.encode()).hexdigest()))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k AS part, v[k * (len(v) // {parts}) + 1:(k + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS k))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
        ctes.append(f"d{k} AS MATERIALIZED (SELECT vec_id, label, part, x, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS r FROM (SELECT vec_id, label, p.part, x, entry, {distance} AS d FROM p JOIN b{k} ON p.part = b{k}.part)) WHERE r = 1)")
        if k < rounds:
            ctes.append(f"s{k} AS MATERIALIZED (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM d{k}) GROUP BY part, entry, i)")
            ctes.append(f"m{k} AS MATERIALIZED (SELECT part, entry, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS c FROM s{k} GROUP BY part, entry)")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b{k}.part, b{k}.entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} ON m{k}.part = b{k}.part AND m{k}.entry = b{k}.entry)")
    ctes.append(f"e AS MATERIALIZED (SELECT vec_id, label, string_agg('0' || substr('0123456789abcdef', entry::INTEGER + 1, 1), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM d{rounds} GROUP BY vec_id, label)")
    ctes.append("l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e GROUP BY label)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN l ON l.label IS NOT DISTINCT FROM e.label, h"


SQL = _sql()
