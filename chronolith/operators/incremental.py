"""Degrees and statistics kept up to date from what changed between two versions of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graphstore import TABLES, GraphStore


def signed(store: GraphStore, name: str, old: int, new: int) -> DataFrame:
    """Rows of the newer (``sign`` 1) and the older version (-1); only buckets whose segments differ are read.

    Rows that did not change are there with both signs, so sums of signs are those of ``changes``, without a shuffle of rows and
    of the columns that are summed by alone.
    """
    a, b = (store.manifest(v) if v else None for v in (old, new))
    before, after = (m.tables.get(name, {}) if m else {} for m in (a, b))
    touched = [k for k in before.keys() | after.keys() if before.get(k) != after.get(k)]
    parts = [store.rows(name, m, touched).select(*TABLES[name].columns, F.lit(sign).alias("sign")) if m else None for m, sign in ((b, 1), (a, -1))]
    return parts[0] if parts[1] is None else parts[0].unionByName(parts[1])


def changes(store: GraphStore, name: str, old: int, new: int) -> DataFrame:
    """Rows that came (``sign`` 1) or went (-1) between two versions; only buckets whose segments differ are read.

    A row whose key stays but whose values change goes and comes.
    """
    return signed(store, name, old, new).groupBy(*TABLES[name].columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def degrees(old: DataFrame, changed: DataFrame) -> DataFrame:
    """``id, degree`` of the ids that have edges, from those before and the edges that changed or are signed; a self-loop counts once."""
    both = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array("src")).otherwise(F.array("src", "dst"))
    ends = changed.select(F.explode(both).alias("id"), F.col("sign").cast("long").alias("degree"))
    return old.select("id", "degree").unionByName(ends).groupBy("id").agg(F.sum("degree").alias("degree")).where("degree <> 0")


def counts(old: DataFrame, changed: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``metric, key, n`` from those before and the rows that changed or are signed; ``keys``: the column that each metric counts by, '' for a total."""
    by = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(c) if c else F.lit("")).alias("key")) for m, c in keys.items()))
    delta = changed.select(F.explode(by).alias("k"), F.col("sign").cast("long").alias("n")).select("k.metric", "k.key", "n")
    return old.unionByName(delta).groupBy("metric", "key").agg(F.sum("n").alias("n")).where("n <> 0")
