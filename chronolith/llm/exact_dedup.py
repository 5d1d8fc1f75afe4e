"""Exact deduplication by a log-structured merge index of digests (DataFrame functions only).

Every task is a memtable: it flushes the digests of its rows as a sorted part of one of the runs, without a shuffle.
Compaction merges runs level by level with map-side combining, keeps the smallest identifier and the count of every
digest, and at the last level drops digests seen once. A bitmap filter over what is left, sized by it, lets the second pass
over the texts skip rows that hit nothing; where it would be too large to broadcast, texts are joined to the hits by a plain shuffle.
Hits are then verified: grouping by digest *and* bytes parts texts that only share a digest, whatever the digest function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted digest runs, their levels, and the filter of what repeats.

    ``flush`` may be called for any number of batches before ``compact``; ``hits`` are the digests
    that more than one row carries.
    """

    #: Runs of a flush, runs that are merged into one of the next level, filter bits for each hit, and bytes of a filter that is broadcast.
    RUNS, FAN, BITS, BROADCAST = 8, 4, 16, 64 << 20

    def __init__(self, broadcast: int = BROADCAST) -> None:
        self.broadcast = broadcast
        self.rows: DataFrame | None = None
        self.runs: list[DataFrame] = []
        self.hits: DataFrame | None = None

    def flush(self, batch: DataFrame) -> DataFrame:
        """Write one batch (digest, ident, and what tells colliding texts apart) as sorted runs, dealt by the tasks that write them."""
        runs = written(batch.withColumn("run", F.spark_partition_id() % self.RUNS).sortWithinPartitions("digest", "ident"), "dedup-run")
        self.rows = runs if self.rows is None else self.rows.unionByName(runs)
        self.runs += [runs.where(F.col("run") == k).select("digest", "ident", F.lit(1).cast("long").alias("n")) for k in range(self.RUNS)]
        return self.rows

    def compact(self) -> DataFrame:
        """Merge all runs: the smallest identifier and the row count of every digest that repeats."""
        level = self.runs
        while len(level) > 1:
            level = [self._merge(level[k : k + self.FAN], last=len(level) <= self.FAN) for k in range(0, len(level), self.FAN)]
        self.hits = level[0]
        return self.hits

    def _merge(self, runs: list[DataFrame], last: bool) -> DataFrame:
        merged = reduce(DataFrame.unionByName, runs).groupBy("digest").agg(F.min("ident").alias("ident"), F.sum("n").alias("n"))
        return written((merged.where("n > 1") if last else merged).sortWithinPartitions("digest"), "dedup-level")

    def may_hit(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest the filter has: all hits, and few others.

        The filter has BITS bits for every hit, so it stays as sharp at any size of the input. It is broadcast up to BROADCAST bytes;
        beyond that rows meet the hits themselves, and each text is shuffled once.
        """
        size = self.hits.count() * self.BITS
        if size > self.broadcast * 8:
            return rows.join(self.hits.select("digest"), "digest", "left_semi")
        bits = max(1 << 15, 1 << max(0, size - 1).bit_length())
        place = F.pmod(F.xxhash64("digest"), F.lit(bits))
        bitmap = (
            self.hits.select(place.alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
        )
        bitmap = written(bitmap, "dedup-filter")
        probed = rows.withColumn("_p", place).withColumn("bucket", F.expr("bitmap_bucket_number(_p)")).withColumn("_bit", F.expr("bitmap_bit_position(_p)"))
        byte = F.expr("cast(conv(hex(substring(bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
        set_ = F.expr("getbit(b, cast(_bit % 8 as int))") == 1
        return probed.join(F.broadcast(bitmap), "bucket").withColumn("b", byte).where(set_).drop("bucket", "_p", "_bit", "bits", "b")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256_digest,
    broadcast: int = DigestIndex.BROADCAST,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, digest, text_sha256``.

    Null texts count as empty, and empty texts equal each other. Of equal texts the row with the
    smallest (or ``keep='largest'``) id stays; null ids lose to any other, and a group of nothing but
    null ids keeps ``keep_id`` null and all its rows. Rows that repeat both id and text are all marked
    as kept and all counted in ``group_size``; ``drop_exact_duplicates`` leaves one. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    order = (lambda c: c) if keep == "smallest" else F.bitwise_not  # reverses the order of integers and cannot overflow
    base = docs.select(order(F.col(id_col).cast("long")).alias("ident"), text.alias("body"))
    own = [] if digest is sha256_digest else [F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha")]
    keyed = base.select("ident", "body", digest(F.col("body")).alias("digest"), F.xxhash64("body").alias("second"), F.octet_length("body").alias("bytes"), *own)

    index = DigestIndex(broadcast)
    run = index.flush(keyed.drop("body"))
    index.compact()

    same = ["digest", "second", "bytes"]
    verified = index.may_hit(keyed.select("ident", "body", *same)).groupBy(*same, "body").agg(F.min("ident").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Equal digest, second hash and length but other bytes: the run cannot tell such texts apart, so it must not go on.
    verified = verified.groupBy(*same).agg(F.min("first").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    verified = verified.withColumn("n", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("texts collide in digest, second hash and length"))))
    verified = written(verified.drop("texts"), "dedup-verified")

    sha = F.col("digest") if digest is sha256_digest else F.col("sha")
    joined = run.join(verified, same, "left")
    first = F.when(F.col("n").isNull(), F.col("ident")).otherwise(F.col("first"))
    return joined.select(
        order(F.col("ident")).alias(id_col),
        order(first).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("ident").eqNullSafe(first).alias("kept"),
        F.lower(F.hex(sha)).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays.

    Rows whose id is null are kept, as nothing tells them apart.
    """
    marks = exact_duplicates(docs, id_col, text_col, keep)
    lost = written(marks.where("not kept").select(F.col(id_col).alias("_lost")).distinct(), "dedup-lost")
    stay = docs.join(lost, docs[id_col] == lost["_lost"], "left_anti")
    twice = written(marks.where("kept").groupBy(F.col(id_col).alias("_twice")).count().where("count > 1 and _twice is not null").select("_twice"), "dedup-twice")
    # Only ids that occur twice are grouped, on id and the text's digest: the rest is not shuffled where the list is small.
    again = stay.join(twice, stay[id_col] == twice["_twice"], "left_semi")
    own = "text_" + "_" * max(map(len, docs.columns))  # longer than any column of theirs
    again = again.withColumn(own, F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates([id_col, own]).drop(own)
    return stay.join(twice, stay[id_col] == twice["_twice"], "left_anti").unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
