"""Substring deduplication with fixed-block anchors.

A repeat of ``window`` words always holds one whole block of the other document's grid, if blocks have
(window + 1) // 2 words. So only the non-overlapping blocks of every document are indexed. Every rolling
window of a block's length probes that index; what hits is extended: the runs of ``window`` words
around the hits, in both documents, are compared with each other, and runs that follow one another
make up the maximal exact repeats.

The index is a table dealt by hash, and the probes are dealt to it, so that both grow with the input. A probe that
only seems to hit adds work and never changes the result: runs are compared by 128 bits of all their words, and
the earliest document of each run decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordBatch, batches_of, cuts_of, gram_hashes, parts_for, release, table

WINDOW = 13
#: Characters of a chunk of texts; bytes of the input that one part of the index, or of the runs, stands for.
CHUNK, PART = 4_000_000, 24 << 20
#: Runs that a task gathers before it sends them.
SEND = 1_500_000

_PROBES = "part int, chunk long, ids binary, first binary, hashes binary, places binary, common binary, anchored binary"
_RUNS = "part int, hashes binary, docs binary, places binary"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()  # of bytes: parts at ASCII white space only


def columns_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def by_key(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each value of ``key``, by which they are sorted."""
    held: list[pd.DataFrame] = []
    for b in batches:
        for lo, hi in cuts_of(b[key].to_numpy()):
            part = b.iloc[lo:hi]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in column if x is not None)])


def packed(places: np.ndarray, kind: type = np.int32) -> bytes:
    """Rising numbers as differences, all first bytes before all second bytes and so on: mostly zeros, which shuffles compress."""
    steps = np.diff(places.astype(kind), prepend=kind(0)).astype(kind)
    return steps.view(np.uint8).reshape(len(steps), -1).T.tobytes() if len(steps) else b""


def unpacked(places: bytes, kind: type = np.int32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def probes(block: int, parts: int) -> Callable:
    """Of chunks of texts: all rolling windows, those that are blocks of the grid marked, dealt by hash.

    What occurs more than once in a chunk is a hit there already; it is sent once, however common it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b["id"].to_numpy(np.int64), b["text"].tolist()
            for part in batches_of(texts, CHUNK):
                yield chunk_probes((task << 32) | number, ids[part], WordBatch(texts[part]), block, parts)
                number += 1

    return run


def chunk_probes(chunk: int, ids: np.ndarray, words: WordBatch, block: int, parts: int) -> pd.DataFrame:
    h, text, place = words.grams(block)
    at = (words.first[text] + place).astype(np.int32)
    anchor = place % block == 0
    value, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    common = count > 1
    again = common[inverse]
    rows = {-1: [chunk % parts, chunk, ids.tobytes(), words.first.astype(np.int64).tobytes(), None, packed(at[again]), None, None]}
    # An index part holds as many blocks at any size of the input, so 32 bits of their hashes are enough.
    own, low = ~again, np.uint64(0xFFFFFFFF)
    part = ((h[own] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, short, mark = part[order], (h[own][order] & low).astype(np.uint32), ((at[own] << 1) | anchor[own])[order]
    for lo, hi in cuts_of(part):
        rows[int(part[lo])] = [int(part[lo]), chunk, None, None, short[lo:hi].tobytes(), packed(mark[lo:hi]), b"", b""]
    anchored = (np.bincount(inverse, anchor, len(value)) > 0)[common]
    part = ((value[common] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, short, anchored = part[order], (value[common][order] & low).astype(np.uint32), anchored[order]
    for lo, hi in cuts_of(part):
        row = rows.setdefault(int(part[lo]), [int(part[lo]), chunk, None, None, b"", b"", b"", b""])
        row[6:] = [short[lo:hi].tobytes(), anchored[lo:hi].tobytes()]
    return pd.DataFrame(list(rows.values()), columns=columns_of(_PROBES))


def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one part of the index: the probes that hit a block of another place, back to their chunks. Heads pass through."""
    release()
    for b in by_key(batches, "part"):
        head = b["ids"].notna()
        yield b[head]
        b = b[~head]
        if not len(b):
            continue
        marks = [unpacked(x) for x in b["places"]]
        mark, short, common = np.concatenate(marks), joined(b["hashes"], np.uint32), joined(b["common"], np.uint32)
        _, inverse = np.unique(np.concatenate([short, common]), return_inverse=True)
        anchored = np.concatenate([mark & 1, joined(b["anchored"], np.uint8)])
        hit = (np.bincount(inverse, np.concatenate([np.ones(len(short)), np.full(len(common), 2)])) > 1) & (np.bincount(inverse, anchored) > 0)
        hit = hit[inverse[: len(short)]]
        ends = np.cumsum([len(x) for x in marks])
        out = []
        for chunk, own, end in zip(b["chunk"], marks, ends, strict=True):
            keep = hit[end - len(own) : end]
            if keep.any():
                out.append((0, chunk, None, None, None, packed(own[keep] >> 1), None, None))
        if out:
            yield pd.DataFrame(out, columns=columns_of(_PROBES))


def by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hits of each chunk's documents, as places of words in the document."""
    release()
    for b in by_key(batches, "chunk"):
        head = b[b["ids"].notna()].iloc[0]
        ids, first = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["first"], np.int64)
        at = np.sort(np.concatenate([unpacked(x) for x in b["places"]]))
        of = np.searchsorted(first, at, "right") - 1
        rows = [(ids[of[lo]], packed(at[lo:hi] - first[of[lo]])) for lo, hi in cuts_of(of)]
        if rows:
            yield pd.DataFrame(rows, columns=["id", "hits"])


def runs(window: int, block: int, parts: int) -> Callable:
    """Runs of ``window`` words around the hits, dealt by hash with the earliest document that has them here.

    Runs that an earlier document of the same task has are settled here, so a run's hash is sent once by a task
    (or once by every SEND runs of it), however common it is.
    """
    inside = window - block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids, texts, found = b["id"].to_numpy(np.int64), b["text"].tolist(), b["hits"].tolist()
            for part in batches_of(texts, CHUNK // 2):
                words = WordBatch(texts[part])
                near = np.zeros(len(words.hashes) + window, np.int32)
                for start, end, own in zip(words.first[:-1], words.first[1:], found[part], strict=True):
                    at = start + unpacked(own)
                    near[at[at < end] + 1] = 1  # rows of one id share their hits, whatever their texts
                total = np.cumsum(near)
                h, text, place = words.grams(window)
                at = words.first[text] + place
                keep = total[at + inside + 1] > total[at]
                g = gram_hashes(words.again(), window)[at[keep]] if keep.any() else np.empty(0, np.uint64)
                held.append((h[keep], g, ids[part][text[keep]], place[keep].astype(np.int32)))
                size += int(keep.sum())
                if size >= SEND:
                    yield from sent(held, parts)
                    held, size = [], 0
        if size:
            yield from sent(held, parts)

    return run


def sent(held: list, parts: int) -> Iterator[pd.DataFrame]:
    h, g, d, p = map(np.concatenate, zip(*held, strict=True))
    later = after_first(h, g, d)
    yield from settled(d[later], p[later], parts)
    h, g, d, p = (x[~later] for x in (h, g, d, p))
    part = ((h >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((p, d, part))
    h, g, d, p, part = (x[order] for x in (h, g, d, p, part))
    rows = [(int(part[lo]), h[lo:hi].tobytes() + g[lo:hi].tobytes(), packed(d[lo:hi], np.int64), packed(p[lo:hi])) for lo, hi in cuts_of(part)]
    if rows:
        yield pd.DataFrame(rows, columns=columns_of(_RUNS))


def after_first(h: np.ndarray, g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which entries have an earlier document under the same two hashes."""
    out = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((d, g, h))
        h, g, d = h[order], g[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def settled(docs: np.ndarray, places: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """Places where repeated runs start, packed by parts of the documents."""
    part = docs % parts
    order = np.lexsort((places, docs, part))
    docs, places, part = docs[order], places[order], part[order]
    rows = [(int(part[lo]), None, packed(docs[lo:hi], np.int64), packed(places[lo:hi])) for lo, hi in cuts_of(part)]
    if rows:
        yield pd.DataFrame(rows, columns=columns_of(_RUNS))


def compare(parts: int) -> Callable:
    """Of all tasks' runs of one part: those that an earlier document has. What is settled passes through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in by_key(batches, "part"):
            done = b["hashes"].isna()
            yield b[done]
            b = b[~done]
            if len(b):
                both = [np.frombuffer(x, np.uint64) for x in b["hashes"]]
                h, g = (np.concatenate([x[: len(x) // 2] if k == 0 else x[len(x) // 2 :] for x in both]) for k in (0, 1))
                d, p = np.concatenate([unpacked(x, np.int64) for x in b["docs"]]), np.concatenate([unpacked(x) for x in b["places"]])
                later = after_first(h, g, d)
                yield from settled(d[later], p[later], parts)

    return run


def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All places of one part of the documents, by document."""
    release()
    for b in by_key(batches, "part"):
        d, p = np.concatenate([unpacked(x, np.int64) for x in b["docs"]]), np.concatenate([unpacked(x) for x in b["places"]])
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        yield pd.DataFrame([(d[lo], packed(p[lo:hi])) for lo, hi in cuts_of(d)], columns=["id", "starts"])


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, starts`` of texts (id, text): the places (in words) where a run starts that also starts in a document with a smaller id."""
    block, parts = (window + 1) // 2, parts_for(rows, PART)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, key).sortWithinPartitions(key)

    found = dealt(rows.mapInPandas(probes(block, parts), _PROBES), "part").mapInPandas(hits, _PROBES)
    found = dealt(found, "chunk").mapInPandas(by_document, "id long, hits binary")
    # Rows of one id that stand in several chunks: each fetches the hits of all.
    near = rows.join(found, "id").select("id", "text", "hits").mapInPandas(runs(window, block, parts), _RUNS)
    return dealt(dealt(near, "part").mapInPandas(compare(parts), _RUNS), "part").mapInPandas(starts, "id long, starts binary")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col, n_words, n_removed, kept_text``: the words of every text that no repeat covers, joined by one space.

    A window is ``window`` consecutive words of one document; it is a repeat if the same words also start in a
    document with a smaller id, judged on the input. Null and empty texts have no words. Rows that repeat an id are one
    document's rows: they never repeat one another. Rows with a null id are left whole. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.where("id is not null")
    covered = repeats(named, window)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            out = []
            for doc, text, own in zip(b["id"], b["text"], b["starts"], strict=True):
                words = words_of(text)
                n = len(words)
                if own is not None and n:
                    change = np.zeros(n + window + 1, np.int32)
                    at = np.unique(unpacked(own))
                    at = at[at + window <= n]
                    change[at] += 1
                    np.add.at(change, at + window, -1)
                    keep = np.cumsum(change)[:n] == 0
                    words = [words[k] for k in np.flatnonzero(keep)]
                out.append((doc, n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=[id_col, "n_words", "n_removed", "kept_text"]).astype({id_col: "Int64"})

    whole = rows.where("id is null").select("id", "text", F.lit(None).cast("binary").alias("starts"))
    both = named.join(covered, "id", "left").select("id", "text", "starts").unionByName(whole)
    return both.mapInPandas(finish, f"`{id_col}` long, n_words long, n_removed long, kept_text string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Words carry their ASCII white space classes as the operator's do; every window of 13 words is compared by its text.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13
), runs AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY array_to_string(words[pos:pos + 12], ' ')) AS first FROM starts
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM runs WHERE first < doc_id
), gone AS (
  SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
