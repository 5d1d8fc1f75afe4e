"""Suffix-array deduplication: every byte that a string of ``window`` bytes covers which also starts earlier goes.

Equal windows have equal minimizers (the least hash of the grams they hold), so the minimizer decides which shard settles a window:

1. Runs of windows with one minimizer are fingerprinted by it and what surely stands beside it in the window, to the left or to the
   right, as a phrase of some words alone makes no repeat. Only runs whose print occurs elsewhere are candidates. Windows of
   prints that very many chunks hold are counted once more by the hash of the whole window, so that a common line
   between differing neighbours does not draw all of these into one shard.
2. The stretches of text that candidate runs cover go to the shard of their minimizer. A task sends equal stretches once, for the
   earliest place; the others are settled there.
3. A shard sorts all suffixes of its stretches by external induced sorting (``induced``), with the common prefixes carried along.
   Windows next to each other that share ``window`` bytes are equal, and all but the earliest are repeats.

Fingerprints only choose what is compared; what is removed is decided by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced
from .common import cuts_of, mixed, parts_for, release, table
from .common import _VALUES as BYTE_VALUES
from .substring_dedup import by_key, columns_of, joined, packed, unpacked

WINDOW, GRAM = 100, 24
#: Bytes of a chunk of texts, of the texts hashed at once, of the stretches a task holds, and of the input that a shard stands for.
CHUNK, SEGMENT, SEND, PART = 4_000_000, 1 << 20, 24_000_000, 12 << 20
#: Shards for each partition: where hashes put several into one, each is sorted on its own, and loads even out.
SHARDS = 4
#: Chunks that hold a print from which on its windows are counted one by one.
HOT = 48
_BASE = 0x9E3779B97F4A7C17

_PRINTS = "part int, chunk long, ids binary, keys binary, first binary, hashes binary, places binary, common binary, numbers binary"
_FOUND = "id long, key long, hits binary, hot binary"
_STRETCHES = "part int, text binary, sizes binary, ids binary, keys binary, starts binary, prints binary"
_MARKS = "part int, ids binary, keys binary, starts binary, counts binary"


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` bytes, from those of lengths that are powers of two."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    run, size, out, at = BYTE_VALUES[0, False][data] ^ np.uint64(0x5851F42D4C957F2D), 1, None, 0
    while True:
        if n & size:
            part = run[at : at + m]
            out = part.copy() if out is None else out * np.uint64(pow(_BASE, size, 2**64)) + part
            at += size
        if size * 2 > n:
            return mixed(out)
        run = run[:-size] * np.uint64(pow(_BASE, size, 2**64)) + run[size:]
        size *= 2


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive values: a minimum from the left and one from the right of blocks."""
    m = len(h) - w + 1
    blocks = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


class Runs:
    """Runs of windows of some texts that share a minimizer and a print: the text of each, where it starts, its windows, minimizer and print.

    A window's minimizer is the first of its least grams. Its print is of the minimizer and what is left of it, if the minimizer lies
    far enough from the window's start, or else of what is right of it; so equal windows have equal prints. Runs that follow one
    another with one minimizer have one ``family``. ``texts`` are few enough to be hashed at once; a text that is longer than a segment
    is cut into segments from its own start, so that its runs are the same in whatever company it comes.
    """

    #: Low bits of a gram's hash that its place in the segment takes, so that the first of the least grams is found with the least.
    PLACE = np.uint64((1 << 21) - 1)

    def __init__(self, texts: list[bytes], window: int, gram: int) -> None:
        found: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
        beside = (window - gram) // 2
        families = 0
        for lo, hi, begin, data in self._segments(texts, window):
            # begin: where in the segment each text begins, and its end; of a part of one text: where in it the segment begins.
            h = gram_hashes(data, gram)
            if len(h) < window - gram + 1:
                continue
            key = sliding_least(h & ~self.PLACE | np.arange(len(h), dtype=np.uint64), window - gram + 1)
            place = (key & self.PLACE).astype(np.int64)
            key &= ~self.PLACE
            side = place - np.arange(len(place)) >= beside
            head = np.concatenate([[True], key[1:] != key[:-1]])  # of a family
            edge = np.concatenate([[True], (place[1:] != place[:-1]) | (side[1:] != side[:-1])])
            if hi == lo + 1:
                of = None
            else:
                of = np.repeat(np.arange(hi - lo), np.diff(begin))[: len(key)]
                inside = np.arange(len(key)) + window <= begin[of + 1]
                head = inside & (head | np.concatenate([[True], of[1:] != of[:-1]]))
                edge &= inside
            at = np.flatnonzero(head | edge)
            prints = self._prints(h, place[at], side[at], gram, beside)
            new = np.concatenate([[True], prints[1:] != prints[:-1]])[: len(at)] | head[at]
            at, prints = at[new], prints[new]
            if of is None:
                text, start, end = np.full(len(at), lo), at + begin[0], np.full(len(at), len(key))
            else:
                text, start, end = of[at] + lo, at - begin[of[at]], begin[of[at] + 1] - window + 1
            size = np.minimum(np.append(at[1:], len(key)), end) - at
            family = np.cumsum(head[at]) - 1
            first = np.flatnonzero(head[at])
            last = np.append(first[1:], len(at)) - 1
            # A family that holds its minimizer at several places may repeat itself.
            twice = place[at[last] + size[last] - 1] > place[at[first]]
            for k, x in enumerate((text, start, size, family + families, mixed(key[at]), prints, twice[family])):
                found[k].append(x)
            families += len(first)
        self.text, self.start, self.size, self.family = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in found[:4])
        self.least, self.prints = (np.concatenate([np.empty(0, np.uint64), *x]) for x in found[4:6])
        self.twice = np.concatenate([np.empty(0, bool), *found[6]])
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    @staticmethod
    def _prints(h: np.ndarray, place: np.ndarray, left: np.ndarray, gram: int, beside: int) -> np.ndarray:
        """Hashes of ``beside`` bytes and the gram to their right (``left``), or of the gram and as many bytes right of it, from those of grams."""
        begin = np.where(left, place - beside, place)
        out = left.astype(np.uint64)
        for at in [*range(0, beside, gram), beside]:
            out = out * np.uint64(_BASE) + h[begin + at]
        return mixed(out)

    @staticmethod
    def _segments(texts: list[bytes], window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for part in byte_batches(texts, SEGMENT):
            lo, hi = part.start, part.stop
            if hi == lo + 1:
                data = np.frombuffer(texts[lo], np.uint8)
                for at in range(0, max(1, len(data) - window + 1), SEGMENT):
                    yield lo, hi, np.array([at]), data[at : at + SEGMENT + window - 1]
            else:
                yield lo, hi, np.concatenate([[0], np.cumsum([len(t) for t in texts[part]])]), np.frombuffer(b"".join(texts[part]), np.uint8)


def byte_batches(texts: list[bytes], size: int) -> Iterator[slice]:
    lo, total = 0, 0
    for k, t in enumerate(texts):
        if k > lo and total + len(t) > size:
            yield slice(lo, k)
            lo, total = k, 0
        total += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


def encoded(column: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in column]


def chunk_prints(chunk: int, ids: np.ndarray, keys: np.ndarray, first: np.ndarray, h: np.ndarray, parts: int, twice: np.ndarray | None = None) -> pd.DataFrame:
    """The fingerprints of a chunk, dealt by hash. One that occurs more than once here is sent once; its places stay with the head.

    So is one of a run that holds it twice (``twice``), as two windows of that run may be equal.
    """
    value, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    common = count > 1
    if twice is not None:
        common |= np.bincount(inverse, twice, len(value)) > 0
    number = np.cumsum(common) - 1
    again = np.flatnonzero(common[inverse])
    again = again[np.argsort(number[inverse[again]], kind="stable")]
    head = [chunk % parts, chunk, ids.tobytes(), keys.tobytes(), first.astype(np.int64).tobytes(), None, again.astype(np.int32).tobytes(), None, count[common].astype(np.int32).tobytes()]
    rows: dict[int, list] = {-1: head}
    low = np.uint64(0xFFFFFFFF)
    own = np.flatnonzero(~common[inverse])
    for hashes, numbers, slot in ((h[own], own, 5), (value[common], np.arange(int(common.sum())), 7)):
        part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, short, numbers = part[order], (hashes[order] & low).astype(np.uint32), numbers[order]
        for lo, hi in cuts_of(part):
            row = rows.setdefault(int(part[lo]), [int(part[lo]), chunk, None, None, None, b"", b"", b"", b""])
            row[slot : slot + 2] = [short[lo:hi].tobytes(), packed(numbers[lo:hi])]
    return pd.DataFrame(list(rows.values()), columns=columns_of(_PRINTS))


def run_prints(parts: int, window: int, gram: int) -> Callable:
    """Of chunks of texts: the print of every run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = encoded(b.pop("text"))
            for part in byte_batches(texts, CHUNK):
                runs = Runs(texts[part], window, gram)
                yield chunk_prints((task << 32) | number, b["id"].to_numpy(np.int64)[part], b["key"].to_numpy(np.int64)[part], runs.first, runs.prints, parts, runs.twice)
                number += 1

    return run


def hot_windows(runs: Runs, k: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of a text's hot runs start, and the run of each."""
    at = runs.first[k] + hot
    size = runs.size[at]
    run = np.repeat(at, size)
    return runs.start[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size), run


def window_prints(parts: int, window: int, gram: int) -> Callable:
    """Of texts with hot runs: the hash of every window of these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, hot = encoded(b.pop("text")), b["hot"].tolist()
            for part in byte_batches(texts, CHUNK):
                runs, hashes = Runs(texts[part], window, gram), []
                for k, text in enumerate(texts[part]):
                    start, _ = hot_windows(runs, k, unpacked(hot[part][k]))
                    hashes.append(window_hashes(text, start, window))
                first = np.cumsum([0, *map(len, hashes)])
                yield chunk_prints((task << 32) | number, b["id"].to_numpy(np.int64)[part], b["key"].to_numpy(np.int64)[part], first, np.concatenate(hashes), parts)
                number += 1

    return run


def window_hashes(text: bytes, start: np.ndarray, window: int) -> np.ndarray:
    data, out = np.frombuffer(text, np.uint8), np.empty(len(start), np.uint64)
    for lo in range(0, len(data), SEGMENT):
        own = slice(*np.searchsorted(start, [lo, lo + SEGMENT]))
        if own.stop > own.start:
            out[own] = gram_hashes(data[lo : lo + SEGMENT + window - 1], window)[start[own] - lo]
    return out


def hits(hot: int) -> Callable:
    """Of one part of the fingerprints: those that occur elsewhere, and those that very many chunks hold, back to their chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in by_key(batches, "part"):
            head = b["ids"].notna()
            yield b[head]
            b = b[~head]
            if not len(b):
                continue
            own, numbers = [unpacked(x) for x in b["places"]], [unpacked(x) for x in b["numbers"]]
            short, common = joined(b["hashes"], np.uint32), joined(b["common"], np.uint32)
            _, inverse = np.unique(np.concatenate([short, common]), return_inverse=True)
            worth = np.concatenate([np.ones(len(short)), np.full(len(common), 2)])
            hit, many = (np.bincount(inverse, worth) > 1)[inverse], (np.bincount(inverse) >= hot)[inverse]
            out, i, j = [], 0, len(short)
            for chunk, x, y in zip(b["chunk"], own, numbers, strict=True):
                hit_x, many_x, many_y = hit[i : i + len(x)], many[i : i + len(x)], many[j : j + len(y)]
                i, j = i + len(x), j + len(y)
                if hit_x.any() or many_y.any():
                    out.append((0, chunk, None, None, None, None, packed(x[hit_x] << 1 | many_x[hit_x]), None, packed(y[many_y])))
            if out:
                yield pd.DataFrame(out, columns=columns_of(_PRINTS))

    return run


def by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hits of each chunk's texts, and the hot ones among them, as numbers within the text."""
    release()
    for b in by_key(batches, "chunk"):
        is_head = b["ids"].notna()
        head, rest = b[is_head].iloc[0], b[~is_head]
        ids, keys, first = (np.frombuffer(head[k], np.int64) for k in ("ids", "keys", "first"))
        again, count = np.frombuffer(head["places"], np.int32), np.frombuffer(head["numbers"], np.int32)
        many = np.zeros(len(count), bool)
        for x in rest["numbers"]:
            many[unpacked(x)] = True
        marks = np.concatenate([again << 1 | np.repeat(many, count), *(unpacked(x) for x in rest["places"])]).astype(np.int64)
        marks.sort()
        at, hot = marks >> 1, (marks & 1).astype(bool)
        of = np.searchsorted(first, at, "right") - 1
        rows = []
        for lo, hi in cuts_of(of):
            own = at[lo:hi] - first[of[lo]]
            rows.append((ids[of[lo]], keys[of[lo]], packed(own), packed(own[hot[lo:hi]]) if hot[lo:hi].any() else None))
        if rows:
            yield pd.DataFrame(rows, columns=columns_of(_FOUND))


def stretches(shards: int, parts: int, window: int, gram: int) -> Callable:
    """The texts of candidate runs, dealt by minimizer: equal ones once, from the earliest place; later ones are settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen: dict[bytes, list] = {}
        size = 0
        for b in batches:
            texts, ids, keys = encoded(b.pop("text")), b["id"].tolist(), b["key"].tolist()
            found, windows = b["hits"].tolist(), b["windows"].tolist()
            hots = b["hot"].tolist()
            for part in byte_batches(texts, CHUNK):
                runs = Runs(texts[part], window, gram)
                for k, text in enumerate(texts[part]):
                    i = part.start + k
                    own = unpacked(found[i])
                    hot = unpacked(hots[i]) if hots[i] is not None else own[:0]
                    at = runs.first[k] + np.setdiff1d(own, hot)
                    start, count, least, twice = runs.start[at], runs.size[at], runs.least[at], runs.twice[at]
                    if len(at):  # what follows one another in a family is one stretch
                        new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + count[:-1]) | (runs.family[at[1:]] != runs.family[at[:-1]])]))
                        start, count, least, twice = start[new], np.add.reduceat(count, new), least[new], twice[new]
                    if len(hot) and windows[i] is not None:
                        w, of = hot_windows(runs, k, hot)
                        kept = unpacked(windows[i])
                        w, of = w[kept], of[kept]
                        new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1] + 1) | (runs.family[of[1:]] != runs.family[of[:-1]])]))
                        start, count, least = np.append(start, w[new]), np.append(count, np.diff(np.append(new, len(w)))), np.append(least, runs.least[of[new]])
                        twice = np.append(twice, runs.twice[of[new]])
                    shard = ((least >> np.uint64(20)) % np.uint64(shards)).tolist()
                    prints = (least.astype(np.uint32) & np.uint32(0xFFFFFFFE) | twice).tolist()
                    for s, n, p, f in zip(start.tolist(), count.tolist(), shard, prints, strict=True):
                        x = text[s : s + n + window - 1]
                        held = seen.get(x)
                        if held is None:
                            seen[x] = [p, f, (ids[i], s, keys[i])]
                            size += len(x) + 150
                        else:
                            held.append((ids[i], s, keys[i]))
                            size += 60
                if size >= SEND:
                    yield from sent(seen, parts, window)
                    seen, size = {}, 0
        if seen:
            yield from sent(seen, parts, window)

    return run


def sent(seen: dict[bytes, list], parts: int, window: int) -> Iterator[pd.DataFrame]:
    shards: dict[int, list] = {}
    done: list[tuple] = []
    for text, (shard, print_, *places) in seen.items():
        first = min(places)
        for p in places:
            if p[:2] == first[:2]:  # rows that share an id also share its place
                shards.setdefault(shard, []).append((text, p, print_))
            else:
                done.append((p[0], p[2], p[1], len(text) - window + 1))
    rows = []
    for shard, own in shards.items():
        texts, places, prints = zip(*own, strict=True)
        sizes = np.array([len(t) for t in texts], np.int32)
        ids, starts, keys = (np.array(x) for x in zip(*places, strict=True))
        rows.append((shard, b"".join(texts), sizes.tobytes(), ids.astype(np.int64).tobytes(), keys.astype(np.int64).tobytes(), starts.astype(np.int32).tobytes(), np.array(prints, np.uint32).tobytes()))
    if rows:
        yield pd.DataFrame(rows, columns=columns_of(_STRETCHES))
    if done:
        for m in marks(*(np.array(x, np.int64) for x in zip(*done, strict=True)), parts):
            yield pd.DataFrame({"part": m["part"], "text": None, "sizes": m["counts"], "ids": m["ids"], "keys": m["keys"], "starts": m["starts"], "prints": None})


def marks(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """Ranges of windows that are repeats, by parts of the texts."""
    part = (mixed(ids.astype(np.uint64) + keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((starts, keys, ids, part))
    ids, keys, starts, counts, part = (x[order] for x in (ids, keys, starts, counts, part))
    rows = [(int(part[lo]), ids[lo:hi].tobytes(), keys[lo:hi].tobytes(), starts[lo:hi].astype(np.int32).tobytes(), counts[lo:hi].astype(np.int32).tobytes()) for lo, hi in cuts_of(part)]
    if rows:
        yield pd.DataFrame(rows, columns=columns_of(_MARKS))


def shard(parts: int, window: int, base: int = induced.BASE) -> Callable:
    """Of the stretches of one shard: the windows that also start earlier. What is settled passes through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in by_key(batches, "part"):
            done = b[b["text"].isna()]
            if len(done):
                yield done.rename(columns={"sizes": "counts"})[columns_of(_MARKS)]
            b = b[b["text"].notna()]
            if len(b):
                yield from repeated(b, window, parts, base)

    return run


def repeated(b: pd.DataFrame, window: int, parts: int, base: int) -> Iterator[pd.DataFrame]:
    texts: list[bytes] = []
    for whole, sizes in zip(b["text"], b["sizes"], strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        texts += [bytes(whole[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    ids, keys, starts = joined(b["ids"], np.int64), joined(b["keys"], np.int64), joined(b["starts"], np.int32)
    size = np.array([len(t) for t in texts], np.int64)
    # Stretches that other tasks sent too: the earliest is sorted, the others follow it.
    first: dict[bytes, int] = {}
    order = np.lexsort((starts, ids))
    twin = np.full(len(texts), -1)
    for i in order.tolist():
        j = first.setdefault(texts[i], i)
        if j != i and (ids[i], starts[i]) != (ids[j], starts[j]):
            twin[i] = j
    own = np.flatnonzero(twin < 0)
    gone = np.flatnonzero(twin >= 0)
    yield from marks(ids[gone], keys[gone], starts[gone].astype(np.int64), size[gone] - window + 1, parts)
    # A stretch that is alone with its minimizer and does not hold it twice has no equal window anywhere.
    prints = joined(b["prints"], np.uint32)[own]
    _, group, count = np.unique(prints & np.uint32(0xFFFFFFFE), return_inverse=True, return_counts=True)
    own = own[(count[group] > 1) | (prints & 1 > 0)]
    if not len(own):
        return
    begin, suffixes = induced.sorted_suffixes([texts[i] for i in own], window, base)
    del texts, first
    ids, keys, starts, last = ids[own], keys[own], starts[own].astype(np.int64), begin + size[own] - window

    def place(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.searchsorted(begin, pos, "right") - 1
        return ids[of], starts[of] + pos - begin[of]

    def whole(pos: np.ndarray) -> np.ndarray:
        return pos <= last[np.searchsorted(begin, pos, "right") - 1]

    found = np.sort(np.concatenate([np.empty(0, np.int32), *induced.later(suffixes, window, place, whole)]))
    if len(found):
        of = np.searchsorted(begin, found, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1] + 1) | (of[1:] != of[:-1])]))
        of = of[new]
        yield from marks(ids[of], keys[of], starts[of] + found[new] - begin[of], np.diff(np.append(new, len(found))), parts)


def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All ranges of one part of the texts, by text."""
    release()
    for b in by_key(batches, "part"):
        ids, keys, starts, counts = (joined(b[k], kind) for k, kind in (("ids", np.int64), ("keys", np.int64), ("starts", np.int32), ("counts", np.int32)))
        order = np.lexsort((keys, ids))
        ids, keys, starts, counts = (x[order] for x in (ids, keys, starts, counts))
        edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
        ends = np.append(edge[1:], len(ids))
        yield pd.DataFrame([(ids[lo], keys[lo], starts[lo:hi].tobytes(), counts[lo:hi].tobytes()) for lo, hi in zip(edge, ends, strict=True)], columns=["id", "key", "starts", "counts"])


def repeats(rows: DataFrame, window: int, gram: int, hot: int, base: int) -> DataFrame:
    """``id, key, starts, counts``: ranges of windows of texts (id, key, text) that also start earlier."""
    parts = parts_for(rows, PART)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, key).sortWithinPartitions(key)

    def found(prints: DataFrame) -> DataFrame:
        return dealt(dealt(prints, "part").mapInPandas(hits(hot), _PRINTS), "chunk").mapInPandas(by_document, _FOUND)

    on = ["id", "key"]
    first = found(rows.mapInPandas(run_prints(parts, window, gram), _PRINTS))
    near = rows.join(first, on).select("id", "key", "text", "hits", "hot")
    again = found(near.where("hot is not null").mapInPandas(window_prints(parts, window, gram), _PRINTS))
    near = near.join(again.select("id", "key", F.col("hits").alias("windows")), on, "left").select("id", "key", "text", "hits", "hot", "windows")
    sent_ = dealt(near.mapInPandas(stretches(parts * SHARDS, parts, window, gram), _STRETCHES), "part")
    return dealt(sent_.mapInPandas(shard(parts, window, base), _MARKS), "part").mapInPandas(ranges, "id long, key long, starts binary, counts binary")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, base: int = induced.BASE) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept`` (binary): every text as UTF-8 without the bytes that a repeat covers.

    A repeat is a string of ``window`` bytes that also starts earlier: in a row with a smaller id, or earlier in a row with the same
    id. Null and empty texts have no bytes, texts shorter than ``window`` stay whole. Rows that repeat an id are told apart by
    their texts, so equal rows get equal results and never remove each other at the same place. Rows with a null id
    stay whole and remove nothing. ``kept`` may cut a character, as strings are judged by bytes. An empty table gives an empty
    result; other columns are ignored. ``window`` is at most 254 and larger than ``gram``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    named = rows.where("id is not null")
    covered = repeats(named, window, gram, hot, base)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            out = []
            for doc, text, starts, counts in zip(b["id"], encoded(b["text"]), b["starts"], b["counts"], strict=True):
                spans = [] if starts is None else merged(np.frombuffer(starts, np.int32), np.frombuffer(counts, np.int32), window)
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(text[lo:hi] for lo, hi in zip(ends, [*(s for s, _ in spans), len(text)], strict=True)) if spans else text
                out.append((doc, len(text), len(text) - len(kept), len(spans), kept))
            yield pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept"]).astype({id_col: "Int64"})

    whole = rows.where("id is null").select("id", "text", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("counts"))
    both = named.join(covered, ["id", "key"], "left").select("id", "text", "starts", "counts").unionByName(whole)
    return both.mapInPandas(finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(starts: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows cover."""
    order = np.argsort(starts, kind="stable")
    lo = starts[order].astype(np.int64)
    hi = np.maximum.accumulate(lo + counts[order] + window - 1)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hex digits; every window of 100 bytes is compared whole.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d)
), r AS (
  SELECT doc_id, p, doc_id::HUGEINT * 4294967296 + p > min(doc_id::HUGEINT * 4294967296 + p) OVER (PARTITION BY s) AS again FROM w
), g AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r WHERE again
), spans AS (
  SELECT doc_id, n, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g) GROUP BY doc_id, n
), pieces AS (
  SELECT doc_id, n, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY n), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY n) || substr(any_value(x), 2 * max(hi) + 1) AS y, count(*) AS n FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(x) // 2 AS n_bytes, (length(x) - length(coalesce(y, x))) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
