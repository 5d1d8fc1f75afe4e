"""The graph's tables as hash-bucketed Parquet segments under one manifest.

``root/segments/<name>/bucket=N`` holds rows, ``root/manifests/<version>`` says which segments make up each bucket of each table.
A batch is written as a delta segment and names only the buckets that it has rows for; compaction folds the segments of those
buckets into one and leaves all others as they are. One manifest puts several tables in place at once: it is created
under the next version's name, which fails if another writer was there first, and carries a checksum, so that one that was cut off is none.

Every value is stored with the number (``seq``) it came with, and rows of one key are folded by these numbers. Folding is
associative, commutative and idempotent: late, repeated or reordered batches, and any compaction, give the same table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ontology import EDGE_FIELDS, NODE_FIELDS
from ..operators.lineage import cut, released


@dataclass(frozen=True)
class Table:
    """``first``: kept from the lowest number; ``filled``: the highest number that is not null; ``last``: the highest number."""

    fields: str
    keys: tuple[str, ...]
    first: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()
    last: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.split(" ")[0] for f in self.fields.split(", ")]

    @property
    def stored(self) -> str:
        """The schema of a segment: the fields, and the numbers of what they hold."""
        numbers = [*(["first"] if self.first else []), *(["last"] if self.last else []), *self.filled]
        return self.fields + ", _n struct<" + ",".join(f"`{n}`:bigint" for n in numbers or ["none"]) + ">"


TABLES = {
    "nodes": Table(NODE_FIELDS, ("id",), ("type", "source"), ("start_date", "end_date", "lat", "lon", "description", "url"), ("label", "props")),
    "edges": Table(EDGE_FIELDS, ("src", "dst", "type", "source"), ("start_date", "end_date"), (), ("label", "confidence", "props")),
    "aliases": Table("node_id string, alias string", ("node_id", "alias")),
    "same_as": Table("a string, b string, method string, score double", ("a", "b"), (), (), ("method", "score")),
    "ingest_log": Table("version long, source string, nodes long, edges long, ran_at timestamp", ("version", "source"), (), (), ("nodes", "edges", "ran_at")),
}


#: Of all buckets together, what rows are dealt out by when they are written.
PARTS = 64


class Conflict(RuntimeError):
    """Another writer committed since this transaction began."""


def numbered(rows: DataFrame, table: Table, seq: Column) -> DataFrame:
    """Rows of a batch in the form of a segment; missing columns are null."""
    parts = [*(["first"] if table.first else []), *(["last"] if table.last else [])]
    numbers = [seq.alias(n) for n in parts] + [F.when(F.col(c).isNotNull() if c in rows.columns else F.lit(False), seq).alias(c) for c in table.filled]
    out = []
    for f in table.fields.split(", "):
        name, kind = f.split(" ")
        out.append((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name))
    return rows.select(*out, F.struct(*(numbers or [F.lit(None).cast("long").alias("none")])).alias("_n"))


def folded(rows: DataFrame, table: Table, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for every key; of equal numbers the greater values count.

    ``by``: columns that follow from the key and are kept. A key that any row marks as ``_gone``, where there is that column, has no row.
    """
    aggs = []
    if table.first:
        aggs.append(F.min(F.struct(F.col("_n.first").alias("n"), *table.first)).alias("_first"))
    if table.last:
        aggs.append(F.max(F.struct(F.col("_n.last").alias("n"), *table.last)).alias("_last"))
    aggs += [F.expr(f"max(struct(_n.`{c}` as n, `{c}` as v)) filter (where `{c}` is not null)").alias(f"_f_{c}") for c in table.filled]
    if marked := "_gone" in rows.columns:
        aggs.append(F.max("_gone").alias("_gone"))
    one = rows.groupBy(*by, *table.keys).agg(*aggs) if aggs else rows.select(*by, *table.keys).distinct()
    one = one.where("not _gone") if marked else one

    def value(c: str) -> Column:
        own = F.col(c) if c in table.keys else F.col(f"_first.{c}") if c in table.first else F.col(f"_last.{c}") if c in table.last else F.col(f"_f_{c}.v")
        return own.alias(c)

    numbers = [*([F.col("_first.n").alias("first")] if table.first else []), *([F.col("_last.n").alias("last")] if table.last else []), *(F.col(f"_f_{c}.n").alias(c) for c in table.filled)]
    return one.select(*by, *map(value, table.columns), F.struct(*(numbers or [F.lit(None).cast("long").alias("none")])).alias("_n"))


def bucket_of(table: Table, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in table.keys)), F.lit(buckets)).cast("int")


@dataclass
class Manifest:
    """``tables``: of every table and bucket the names of its segments. ``marks``: what writers note, such as a stream's last epoch."""

    version: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        body = json.dumps({"version": self.version, "tables": self.tables, "marks": self.marks}, sort_keys=True)
        return hashlib.sha256(body.encode()).hexdigest() + "\n" + body

    @staticmethod
    def of(text: str) -> Manifest | None:
        digest, _, body = text.partition("\n")
        return Manifest(**json.loads(body)) if hashlib.sha256(body.encode()).hexdigest() == digest else None


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # Only small metadata files go through the Hadoop client; rows are read and written by Spark.
    def _path(self, name: str) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest whole manifest, or that of a version; versions whose manifest was cut off do not exist."""
        wanted = [n for n in reversed(self._names("manifests")) if n.isdigit() and (version is None or int(n) == version)]
        for name in wanted:
            if found := self._whole(name):
                return found
        if version is not None:
            raise LookupError(f"no version {version}")
        return Manifest()

    def _whole(self, name: str) -> Manifest | None:
        fs, path = self._path(f"manifests/{name}")
        stream = fs.open(path)
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the newest or a given version."""
        return self.rows(name, self.manifest(version)).select(*TABLES[name].columns)

    def rows(self, name: str, manifest: Manifest, only: list[str] | None = None) -> DataFrame:
        """Rows with their numbers; a bucket of one folded segment is read as it is, others are folded by key."""
        table = TABLES[name]
        own = {b: s for b, s in manifest.tables.get(name, {}).items() if only is None or b in only}
        whole = [f"{s[0]}/bucket={b}" for b, s in own.items() if len(s) == 1 and s[0].endswith("-whole")]
        parts = [f"{x}/bucket={b}" for b, s in own.items() if not (len(s) == 1 and s[0].endswith("-whole")) for x in s]
        return self._load(whole, table).unionByName(folded(self._load(parts, table), table)) if parts else self._load(whole, table)

    def _load(self, paths: list[str], table: Table) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], table.stored)
        return self.spark.read.schema(table.stored).parquet(*(f"{self.root}/segments/{p}" for p in paths))

    def repair(self) -> list[str]:
        """Take away manifests that were cut off, and their names; only while no writer is at work, as one may be writing just now."""
        gone = []
        for name in self._names("manifests"):
            if self._whole(name) is None:
                fs, path = self._path(f"manifests/{name}")
                fs.delete(path, False)
                gone.append(name)
        return gone

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())


class Transaction:
    """Changes of several tables that become visible together, or not at all."""

    def __init__(self, store: GraphStore, base: Manifest) -> None:
        self.store, self.base = store, base
        self.due: dict[str, set[str]] = {}  # buckets that the commit folds
        self.next = Manifest(base.version + 1, {t: {b: list(s) for b, s in own.items()} for t, own in base.tables.items()}, dict(base.marks))

    @property
    def version(self) -> int:
        return self.next.version

    def _write(self, name: str, rows: DataFrame, kind: str) -> tuple[str, list[str]]:
        """A new segment, folded if it is a whole one, and the buckets that it has.

        Rows are dealt out once, by bucket and a part of it, for folding and writing alike. The parts of all buckets are two for
        every shuffle partition of the session, and PARTS at least, so that tasks are even and follow these and not the number of buckets.
        """
        table, segment = TABLES[name], f"{name}-{uuid.uuid4().hex}-{kind}"
        parts = -(-max(PARTS, 2 * int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))) // self.store.buckets)
        part = F.pmod(F.shiftrightunsigned(F.xxhash64(*table.keys), 32), F.lit(parts)).cast("int")
        out = rows.withColumn("bucket", bucket_of(table, self.store.buckets))
        if kind == "whole":
            out = folded(out.withColumn("_part", part).repartition("bucket", "_part"), table, ("bucket", "_part"))
            out = out.sortWithinPartitions("bucket", "_part", *table.keys).drop("_part")
        else:  # no column more, so that Spark keeps what observes an empty batch
            out = out.repartition(F.col("bucket"), part).sortWithinPartitions("bucket", *table.keys)
        with released(self.store.spark):
            out.write.partitionBy("bucket").parquet(f"{self.store.root}/segments/{segment}")
        return segment, [n.removeprefix("bucket=") for n in self.store._names(f"segments/{segment}") if n.startswith("bucket=")]

    def _numbered(self, name: str, rows: DataFrame, seq: Column | None) -> DataFrame:
        local = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        order = seq if seq is not None else F.lit(self.version << 40) + local
        return numbered(rows, TABLES[name], order.cast("long"))

    def _fold(self, name: str, todo: list[str], gone: str | None = None) -> None:
        """Fold buckets into one segment, without the keys of the segment ``gone``."""
        table, own = TABLES[name], self.next.tables[name]
        rows = self.store._load([f"{s}/bucket={b}" for b in todo for s in own[b]], table)
        if gone:
            keys = self.store._load([f"{gone}/bucket={b}" for b in todo], table)
            rows = rows.withColumn("_gone", F.lit(False)).unionByName(keys.withColumn("_gone", F.lit(True)))
        segment, made = self._write(name, rows, "whole")
        for b in todo:
            own.pop(b)
        own.update({b: [segment] for b in made})
        self.due.get(name, set()).difference_update(todo)

    def append(self, name: str, rows: DataFrame, seq: Column | None = None) -> list[str]:
        """Add a batch to its buckets, which are returned; nothing that is stored is read.

        ``seq`` is a long that orders values of a key over all batches; by default later versions come after earlier ones, and
        within one the column ``seq`` decides, where there is one.
        """
        segment, buckets = self._write(name, self._numbered(name, rows, seq), "delta")
        own = self.next.tables.setdefault(name, {})
        for b in buckets:
            own.setdefault(b, []).append(segment)
        return buckets

    def compact(self, name: str, least: int = 2) -> list[str]:
        """Fold the buckets that have at least so many segments (or one that is not folded) into one segment each; returns them."""
        own = self.next.tables.get(name, {})
        todo = sorted(b for b, s in own.items() if len(s) >= least or (least <= 1 and not s[0].endswith("-whole")))
        if todo:
            self._fold(name, todo)
        return todo

    def merge(self, name: str, rows: DataFrame, seq: Column | None = None) -> list[str]:
        """Add a batch and fold the buckets that it touched, and no others; returns them.

        Where the table is empty the batch is folded as it is written, else by the commit, or by a deletion before it: batches of
        one transaction are folded at once.
        """
        own = self.next.tables.setdefault(name, {})
        if own:
            buckets = self.append(name, rows, seq)
            self.due.setdefault(name, set()).update(buckets)
        else:
            segment, buckets = self._write(name, self._numbered(name, rows, seq), "whole")
            own.update({b: [segment] for b in buckets})
        return buckets

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        self.next.tables[name] = {}
        self.merge(name, rows)

    def delete(self, name: str, gone: DataFrame) -> list[str]:
        """Take out the rows whose keys are in ``gone``; only the buckets of these keys are rewritten. Returns them.

        The keys are computed once and stored by bucket; they meet the rows while these are folded, in no further shuffle.
        """
        table, own = TABLES[name], self.next.tables.get(name, {})
        keys = gone.select(*table.keys).dropna()  # a null equals no key
        segment, found = self._write(name, numbered(keys, table, F.lit(None).cast("long")), "gone")
        todo = sorted({*found} & own.keys())
        if todo:
            self._fold(name, todo, segment)
        return todo

    def delete_nodes(self, ids: DataFrame) -> None:
        """Take out nodes (id) with their edges and aliases; identity links stay."""
        ids = cut(ids.select("id").distinct())
        edges = self.store.rows("edges", self.next)
        touched = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*TABLES["edges"].keys).unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*TABLES["edges"].keys))
        aliases = self.store.rows("aliases", self.next).join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
        self.delete("edges", touched)
        self.delete("aliases", aliases)
        self.delete("nodes", ids)

    def commit(self) -> Manifest:
        """Put the manifest in place; Conflict if another one of this version is there."""
        if self.store.manifest().version != self.base.version:
            raise Conflict(f"version {self.store.manifest().version} came in between")
        for name, buckets in self.due.items():
            if todo := sorted(buckets & self.next.tables.get(name, {}).keys()):
                self._fold(name, todo)
        fs, path = self.store._path(f"manifests/{self.version:012d}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {self.version} was committed, is being written, or was cut off") from e
        try:
            out.write(bytearray(self.next.text().encode()))
        finally:
            out.close()
        return self.next
