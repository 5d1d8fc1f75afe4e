"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct shingle sets ("classes": documents with equal sets are one
row); its columns are shingles. The matrix is cut into blocks of columns, one a task. A block counts the rows of
each of its columns, and gives back to a row only the columns that it shares. Sizes bound what is left:

- a row that shares too few columns in all cannot link and goes before any product;
- the shared columns of a row are ordered by their counts, rare ones first. Of a pair that reaches the threshold, the
  first common column stands among the first few of either row, and among fewer still of the smaller one. Rows
  are multiplied only in such columns, and only if sizes, positions and sketches leave room for enough overlap;
- the product accumulates the overlap of a pair block by block of columns, and drops the pair once the
  count and all that is left of the row cannot reach the bound.

No group is expanded into its pairs: in every column each row is first multiplied with one pivot row. What is
linked is contracted to components; only rows of a column that lie in different components are compared after
that, block by block inside the tasks, and only pairs that pass all bounds leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordBatch, batches_of, cuts_of, gram_hashes, mixed, parts_for, release, table, text_slices, written
from .components import components

#: Words of a shingle; similarity in percent.
WORDS, PERCENT = 5, 80
#: Bytes of a chunk of texts; bytes of the input that one block of columns stands for.
CHUNK, PART = 4_000_000, 16 << 20
#: Partners of a pivot that are multiplied in one task, and rows of a block of one column.
PARTNERS, BLOCK = 256, 512
#: Bits of a sketch at least and at most.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Column blocks that a pair's overlap is accumulated in (a power of two), and entries that a task multiplies at once.
PIECES, ENTRIES = 8, 1_000_000

_DOC = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<i8"), ("class", "<i8"), ("check", "<i8")])
_COLUMNS = ["part", "chunk", "docs", "hashes", "rows", "counts"]
_SENT = "part int, chunk long, docs binary, hashes binary, rows binary, counts binary"
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in _COLUMNS[2:])])
_ROWS = "id long, n long, class long, check long, columns array<long>, sketch binary"


def shingle_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; fewer words than ``n`` are one shingle. Only A-Z are lowered."""
    for part in batches_of(texts):
        words = WordBatch(texts[part], lower=True)
        h, text, _ = words.grams(n)
        cuts = np.searchsorted(text, np.arange(1, len(words.first) - 1))
        for own, first, end in zip(np.split(h, cuts), words.first[:-1], words.first[1:], strict=True):
            if 0 < end - first < n:
                own = mixed(gram_hashes(words.hashes[first:end], int(end - first)) + np.uint64(end - first))
            yield np.unique(own)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, which name its class together; 0 and 0 for the empty one."""
    if not len(s):
        return 0, 0
    one = mixed(s.sum(keepdims=True) + np.uint64(len(s)))
    two = mixed(np.bitwise_xor.reduce(mixed(s ^ np.uint64(0xA0761D6478BD642F)), keepdims=True))
    return int(one[0].view(np.int64)), int(two[0].view(np.int64))


def need(n, m, percent: int):  # noqa: ANN001, ANN201
    """The least overlap of a link, of numbers or arrays: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def probe_length(n, percent: int):  # noqa: ANN001, ANN201
    """First columns of a row that hold the first column common with any partner."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):  # noqa: ANN001, ANN201
    """First columns of a row that hold the first column common with a partner that is no smaller."""
    return n - need(n, n, percent) + 1


def sketch_of(columns: np.ndarray) -> bytes:
    """Parities of the columns that fall to each bit: where two rows' bits differ, the rows differ in at least one column."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(columns)).bit_length()))
    odd = np.bincount((mixed(columns) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def blocks_of_columns(words: int, parts: int) -> Callable:
    """Chunks of texts as blocks of columns, and a head with the chunk's documents.

    A chunk sends a shingle once: with its row if one row of the chunk has it, else with the number of its rows, which the
    head keeps. So a block gets no more of a common shingle than there are chunks. Sets that the task has sent go without columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        for b in batches:
            ids, lost = b.column("id").to_numpy(), b.column("lost").to_pylist()
            for part, texts in text_slices(b.column("text"), CHUNK):
                docs, fresh, rows = np.zeros(len(texts), _DOC), [], []
                for k, (doc, null, s) in enumerate(zip(ids[part], lost[part], shingle_sets(texts, words), strict=True)):
                    key = class_of(s)
                    docs[k] = (doc, null, len(s), *key)
                    if len(s) and key not in seen:
                        seen.add(key)
                        fresh.append(k)
                        rows.append(s)
                yield pa.RecordBatch.from_pandas(sent((task << 32) | number, docs, np.array(fresh, np.int32), rows, parts), _ARROW, preserve_index=False)
                number += 1

    return run


def sent(chunk: int, docs: np.ndarray, fresh: np.ndarray, rows: list[np.ndarray], parts: int) -> pd.DataFrame:
    h = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    of = np.repeat(fresh, [len(s) for s in rows])
    value, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    alone = count[inverse] == 1
    out = [(chunk % parts, chunk, docs.tobytes(), h[~alone].tobytes(), of[~alone].tobytes(), None)]
    again = count > 1
    blocks: dict[int, list] = {}
    for place, own, more in ((3, h[alone], of[alone]), (5, value[again], count[again].astype(np.int32))):
        part = ((own >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, own, more = part[order], own[order], more[order]
        for lo, hi in cuts_of(part):
            row = blocks.setdefault(int(part[lo]), [int(part[lo]), chunk, None, b"", b"", b""])
            row[3] += own[lo:hi].tobytes()
            # Rows go as differences, which shuffles compress.
            row[4 if place == 3 else 5] = np.diff(more[lo:hi], prepend=np.int32(0)).tobytes() if place == 3 else more[lo:hi].tobytes()
    return pd.DataFrame(out + list(blocks.values()), columns=_COLUMNS)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block: the columns that several rows have, with their counts, back to the chunks. Heads pass through."""
    release()
    now, held = None, []
    for b in batches:  # sorted by block
        head = b["docs"].notna()
        yield b[head]
        for part, chunk, hashes, rows, counts in b.loc[~head, ["part", "chunk", "hashes", "rows", "counts"]].itertuples(index=False):
            if part != now and held:
                yield from replies(held)
                held = []
            now = part
            held.append((chunk, np.frombuffer(hashes, np.uint64), np.frombuffer(rows, np.int32), np.frombuffer(counts, np.int32)))
    if held:
        yield from replies(held)


def replies(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    _, inverse = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
    weight = np.concatenate([np.concatenate([np.ones(len(rows), np.int32), counts]) for _, _, rows, counts in held])
    total = np.minimum(np.bincount(inverse, weight), 2**31 - 1).astype(np.int32)[inverse]
    at = 0
    for chunk, hashes, rows, _ in held:
        own = total[at : at + len(hashes)]
        at += len(hashes)
        one, many = slice(0, len(rows)), slice(len(rows), None)
        keep = own[one] > 1
        out = []
        if keep.any():
            out.append((0, chunk, None, hashes[one][keep].tobytes(), np.cumsum(rows, dtype=np.int32)[keep].tobytes(), own[one][keep].tobytes()))
        if len(hashes) > len(rows):
            out.append((0, chunk, None, hashes[many].tobytes(), None, own[many].tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)


def shared_columns(percent: int) -> Callable:
    """A row per document of a chunk; those that share enough columns with other rows get these, by count and hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        now, held = None, []
        for b in batches:  # sorted by chunk
            for row in b[["chunk", "docs", "hashes", "rows", "counts"]].itertuples(index=False):
                if row.chunk != now and held:
                    yield finished(held, percent)
                    held = []
                now = row.chunk
                held.append(row)
        if held:
            yield finished(held, percent)

    return run


def finished(held: list, percent: int) -> pd.DataFrame:
    def joined(rows: list, kind: type, name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *(np.frombuffer(getattr(r, name), kind) for r in rows)])

    head = next(r for r in held if r.docs is not None)
    docs = np.frombuffer(head.docs, _DOC)
    one, many = [r for r in held if r.docs is None and r.rows is not None], [r for r in held if r.docs is None and r.rows is None]
    common, counts = joined(many, np.uint64, "hashes"), joined(many, np.int32, "counts")
    order = np.argsort(common)
    own = np.frombuffer(head.hashes, np.uint64)
    own_count = counts[order][np.searchsorted(common[order], own)] if len(own) else np.empty(0, np.int32)
    h = np.concatenate([joined(one, np.uint64, "hashes"), own])
    of = np.concatenate([joined(one, np.int32, "rows"), np.frombuffer(head.rows, np.int32)])
    count = np.concatenate([joined(one, np.int32, "counts"), own_count])
    shared = np.bincount(of, minlength=len(docs))
    live = (docs["n"] > 0) & (shared >= -(-percent * docs["n"] // 100))
    keep = live[of]
    h, of, count = h[keep], of[keep], count[keep]
    order = np.lexsort((h, count, of))
    h, of = h[order], of[order]
    columns, sketches = [None] * len(docs), [None] * len(docs)
    for lo, hi in cuts_of(of):
        columns[of[lo]], sketches[of[lo]] = h[lo:hi].view(np.int64), sketch_of(h[lo:hi])
    ids = pd.array(docs["id"], "Int64")
    ids[docs["null"]] = pd.NA
    return pd.DataFrame({"id": ids, "n": docs["n"], "class": docs["class"], "check": docs["check"], "columns": columns, "sketch": sketches})


def incidence(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, n, class, check, columns, sketch) of every document: its set's size and class, and what it shares if that may be enough."""
    parts = parts_for(docs, PART)
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("lost"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(blocks_of_columns(words, parts), _SENT).repartition(parts, "part").sortWithinPartitions("part").mapInPandas(counted, _SENT)
    return found.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInPandas(shared_columns(percent), _ROWS)


def _need(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def links(live: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes, enough of them to connect all that is connected.

    ``live``: node, n, columns and sketch of each class that may link, a stored table.
    """
    n, own = F.col("n"), F.size("columns").cast("long")
    first = live.select("node", "n", own.alias("s"), F.posexplode(F.slice("columns", F.lit(1), (n - F.ceil(n * percent / 100) + 1 - (n - own)).cast("int"))).alias("at", "column"))
    place = F.col("n") - F.col("s") + F.col("at")  # what only this row has comes first in the order
    entries = written(first.select("node", "n", "s", place.alias("i"), "column", (place < F.col("n") - _need(n, n, percent) + 1).alias("index")), "ngram-entries")
    placed = entries.withColumn("component", F.col("node"))
    found: DataFrame | None = None
    for order in (F.xxhash64("node"), -F.xxhash64(F.bitwise_not("node"))):
        # A row is multiplied with one pivot of each column, the same one in many columns.
        pivots = placed.groupBy("column").agg(F.min_by(F.struct("node", "n", "s", "i", "component", "index"), F.struct(~F.col("index"), order)).alias("p"), F.min("component").alias("c"), F.max("component").alias("d"))
        pivots = written(pivots.where("c <> d and p.index").select("column", "p"), "ngram-pivots")
        x = {k: F.col(k) for k in ("n", "s", "i", "index", "component")}
        y = {k: F.col(f"p.{k}") for k in x}
        tries = placed.join(pivots, "column").where(x["component"] != y["component"]).where(_may_link(x, y, percent))
        new = verified(written(tries.select("node", F.col("p.node").alias("pivot")).distinct(), "ngram-pairs"), live, percent)
        found = new if found is None else found.union(new)
        known = written(components(found), "ngram-known")
        placed = entries.join(known, entries["node"] == known["node"], "left").select(entries["*"], F.coalesce("component", entries["node"]).alias("component"))
        open_ = placed.groupBy("column").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.max("index").alias("any")).where("c <> d and any").select("column")
        placed = written(placed.join(open_, "column", "left_semi"), "ngram-open")
    pairs = written(open_pairs(placed, live.select("node", "sketch"), percent).distinct(), "ngram-pairs")
    return found.union(verified(pairs, live, percent))


def _may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether sizes, shared columns and the places of one common column leave room for a link; y's place is indexed."""
    n, m, i, j = x["n"], y["n"], x["i"], y["i"]
    least = _need(n, m, percent)
    room = F.least(i, j) + 1 + F.least(n - 1 - i, m - 1 - j)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((n >= m) | x["index"]) & (F.least(x["s"], y["s"]) >= least) & (room >= least)


def open_pairs(placed: DataFrame, sketches: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (node, pivot) of different components that share a column and pass all bounds.

    The rows of a column are dealt in blocks, those of its most frequent component apart from the rest: its rows meet the rest only.
    """
    sizes = placed.groupBy("column", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("column").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("g"), F.sum("k").alias("k"))
    sizes = written(sizes.select("column", "main", F.ceil(F.col("g") / block).cast("int").alias("g"), F.ceil((F.col("k") - F.col("g")) / block).cast("int").alias("o")), "ngram-sizes")
    rows = placed.join(sizes, "column")
    main = F.col("component") == F.col("main")
    own = F.when(main, F.pmod(F.xxhash64("node"), F.col("g"))).otherwise(F.col("g") + F.pmod(F.xxhash64("node"), F.col("o"))).cast("int")
    other = F.explode(F.sequence(F.when(main, F.col("g")).otherwise(0), F.col("g") + F.col("o") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    key = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    dealt = dealt.join(sketches, "node").select("column", *key, (F.col("own") > F.col("other")).alias("side"), "node", "n", "s", "i", "index", "component", "sketch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        rest = None
        for b in batches:  # sorted by column and blocks
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            code = b[["column", "low", "high"]].to_numpy()
            cuts = cuts_of_rows(code)
            for lo, hi in cuts[:-1]:
                yield from close_pairs(b.iloc[lo:hi], percent)
            rest = b.iloc[cuts[-1][0] :] if cuts else b
        if rest is not None and len(rest):
            yield from close_pairs(rest, percent)

    dealt = dealt.repartition("column", "low", "high").sortWithinPartitions("column", "low", "high")
    return dealt.mapInPandas(run, "node long, pivot long")


def cuts_of_rows(code: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist(), len(code)]
    return list(zip(edge[:-1], edge[1:], strict=True)) if len(code) else []


def close_pairs(b: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """Of two blocks (or one with itself) of a column: the pairs that all bounds and the sketches leave."""
    if len(b) < 2:
        return
    same = b["low"].iloc[0] == b["high"].iloc[0]
    side = b["side"].to_numpy(bool)
    left, right = (np.arange(len(b)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
    n, s, i, index, component, node = (b[k].to_numpy() for k in ("n", "s", "i", "index", "component", "node"))
    x, y = left[:, None], right[None, :]
    smaller = np.where(n[x] < n[y], index[x], np.where(n[x] > n[y], index[y], index[x] | index[y]))
    least = need(n[x], n[y], percent)
    room = np.minimum(i[x], i[y]) + 1 + np.minimum(n[x] - 1 - i[x], n[y] - 1 - i[y])
    ok = (component[x] != component[y]) & smaller & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & (np.minimum(s[x], s[y]) >= least) & (room >= least)
    if same:
        ok &= x < y
    p, q = np.nonzero(ok)
    p, q = left[p], right[q]
    if not len(p):
        return
    size = b["sketch"].map(len).to_numpy() * 8
    both = np.minimum(size[p], size[q])
    for bits in np.unique(both):
        on = np.flatnonzero(both == bits)
        rows = np.unique(np.concatenate([p[on], q[on]]))
        bit = np.zeros((len(rows), bits // 64), np.uint64)
        for k, r in enumerate(rows):
            bit[k] = np.bitwise_xor.reduce(np.frombuffer(b["sketch"].iloc[r], np.uint64).reshape(-1, bits // 64), axis=0)
        for lo in range(0, len(on), 1 << 14):
            part = on[lo : lo + (1 << 14)]
            a, c = p[part], q[part]
            apart = np.bitwise_count(bit[np.searchsorted(rows, a)] ^ bit[np.searchsorted(rows, c)]).sum(1, dtype=np.int64)
            keep = (s[a] + s[c] - apart) // 2 >= need(n[a], n[c], percent)
            if keep.any():
                yield pd.DataFrame({"node": np.maximum(node[a], node[c])[keep], "pivot": np.minimum(node[a], node[c])[keep]})


def verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (node, pivot) those that reach the threshold, by the overlap of their shared columns.

    Rows of a block of a pivot's partners stream past the pivot's own row: each row travels once a pair.
    """
    blocks = written(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("long").alias("blocks")), "ngram-blocks")
    partners = pairs.join(blocks, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    itself = blocks.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    places = written(partners.union(itself), "ngram-places")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        now, pivot, held, size = None, None, [], 0

        def done() -> pd.DataFrame:
            linked = overlaps(pivot, held, percent)
            return pd.DataFrame({"a": np.full(len(linked), now[0]), "b": np.array(linked, np.int64)})

        for b in batches:
            for node, own, block, n, row in zip(b["node"], b["pivot"], b["block"], b["n"], b["columns"], strict=True):
                row = np.asarray(row).view(np.uint64)
                if (own, block) != now or size > ENTRIES:
                    if held:
                        yield done()
                    now, held, size = (own, block), [], 0
                if node == own:  # sorted before its partners
                    pivot = (n, np.sort(row))
                else:
                    held.append((node, n, row))
                    size += len(row)
        if held:
            yield done()

    dealt = live.select("node", "n", "columns").join(places, "node").repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("node") != F.col("pivot"))
    return written(dealt.select("node", "pivot", "block", "n", "columns").mapInPandas(product, "a long, b long"), "ngram-verified")


def overlaps(pivot: tuple[int, np.ndarray], partners: list[tuple[int, int, np.ndarray]], percent: int) -> list[int]:
    """The partners that link with the pivot: overlaps accumulate over blocks of columns, and who cannot reach its bound falls out."""
    m, x = pivot
    shift = np.uint64(64 - (PIECES.bit_length() - 1))
    columns = np.concatenate([row for _, _, row in partners])
    left = np.array([len(row) for _, _, row in partners])
    of = np.repeat(np.arange(len(partners)), left)
    least = need(np.array([n for _, n, _ in partners], np.int64), m, percent)
    count = np.zeros(len(partners), np.int64)
    on = left >= least
    for piece in range(PIECES):
        entries = np.flatnonzero(((columns >> shift) == piece) & on[of])
        own = x[(x >> shift) == piece]
        if len(own):
            at = np.minimum(np.searchsorted(own, columns[entries]), len(own) - 1)
            count += np.bincount(of[entries[own[at] == columns[entries]]], minlength=len(partners))
        left = left - np.bincount(of[entries], minlength=len(partners))
        on &= count + left >= least
    return [node for (node, _, _), good in zip(partners, on, strict=True) if good]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id_col, n_shingles, component_id``: one row per document.

    Documents link when 100 * intersection >= percent * union of their distinct shingles. Null and empty texts, and
    texts of nothing but white space, have no shingle and link with nothing. Rows whose id is null are documents like others,
    but their id is nobody's ``component_id``, which is null where a component has no other. Rows that repeat an id are documents of
    their own that share it, one row each. An empty table gives an empty result; other columns are ignored.
    """
    rows = written(incidence(docs, id_col, text_col, words, percent), "ngram-rows")
    key = ["class", "check"]
    live = rows.where("columns is not null").groupBy(*key).agg(F.first("n").alias("n"), F.first("columns").alias("columns"), F.first("sketch").alias("sketch"))
    live = written(live.withColumn("node", F.monotonically_increasing_id()), "ngram-live")
    found = written(components(links(live, percent)), "ngram-components")
    classes = rows.where("n > 0").groupBy(*key).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    node = live.join(found, "node").select(*key, "component")
    classes = written(classes.join(node, key, "left"), "ngram-classes")
    smallest = classes.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    # Only classes of several documents or with links differ from their document.
    of_class = classes.where("component is not null or copies > 1").join(smallest, "component", "left").select(*key, F.coalesce("smallest", "first").alias("component_id"), F.lit(True).alias("linked"))
    of_class = written(of_class, "ngram-result")
    out = rows.select("id", "n", *key).join(of_class, key, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
