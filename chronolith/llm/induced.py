"""Suffix order by external induced sorting, with capped common prefixes, for texts larger than memory.

Suffixes are tuples (position, common prefix with the one before) in a priority queue whose keys are first symbols. Whatever a
bucket induces goes to buckets that are not yet done, in the order in which it is induced, so the queue is one file of tuples
for every key and a heap of keys; beyond a bound the tuples are on disk. One pass upward induces the suffixes that are larger than their
successor, one pass downward the others. The passes start from the order of the local minima's suffixes, which the same passes
over their substrings name, and which recursion over the names settles; names that fit in memory are settled there by doubling.

The order, and with it every common prefix, is only carried to ``depth`` symbols, which is all that a repeat of that length needs.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Symbols of a text: 0 ends it, 1 separates its parts, a byte b is b + 2.
END, BREAK = 0, 1
#: Names up to which doubling in memory settles an order; tuples that one step takes; bytes that a queue keeps in memory.
BASE, STEP, HELD = 6_000_000, 1 << 20, 128 << 20


class Tuples:
    """A priority queue of (position, common prefix): first in, first out for every key, on disk beyond ``held`` bytes."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.bytes, self.end = held, 0, 0
        self.pieces: dict[int, list] = {}
        self.keys: list[int] = []
        self.file = None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if key not in self.pieces:
            self.pieces[key] = []
            heapq.heappush(self.keys, key)
        self.pieces[key].append((pos, lcp))
        self.bytes += pos.nbytes + lcp.nbytes
        if self.bytes > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for pieces in self.pieces.values():
            at = next((k for k, p in enumerate(pieces) if not isinstance(p[0], int)), len(pieces))
            if at == len(pieces):
                continue
            pos, lcp = (np.concatenate([p[k] for p in pieces[at:]]) for k in (0, 1))
            self.file.seek(self.end)
            self.file.write(pos.tobytes() + lcp.tobytes())
            pieces[at:] = [(self.end, len(pos))]
            self.end += pos.nbytes + lcp.nbytes
        self.bytes = 0

    def _load(self, piece: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(piece[0], int):
            self.bytes -= piece[0].nbytes + piece[1].nbytes
            return piece
        self.file.seek(piece[0])
        data = self.file.read(piece[1] * 5)
        return np.frombuffer(data, np.int32, piece[1]), np.frombuffer(data, np.uint8, piece[1], piece[1] * 4)

    def take(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a key in steps, those too that are pushed meanwhile."""
        while self.pieces.get(key):
            pieces, self.pieces[key] = self.pieces[key], []
            held, size = [], 0
            for p in pieces:
                pos, lcp = self._load(p)
                for lo in range(0, len(pos), STEP):
                    held.append((pos[lo : lo + STEP], lcp[lo : lo + STEP]))
                    size += len(held[-1][0])
                    if size >= STEP:
                        yield _joined(held)
                        held, size = [], 0
            if held:
                yield _joined(held)
        self.pieces.pop(key, None)

    def take_back(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a key from the last to the first."""
        held, size = [], 0
        for p in reversed(self.pieces.pop(key, [])):
            pos, lcp = self._load(p)
            held.append((pos[::-1], lcp[::-1]))
            size += len(pos)
            if size >= STEP:
                yield _joined(held)
                held, size = [], 0
        if held:
            yield _joined(held)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _joined(pieces: list) -> tuple[np.ndarray, np.ndarray]:
    return pieces[0] if len(pieces) == 1 else tuple(np.concatenate([p[k] for p in pieces]) for k in (0, 1))


def cells(n: int, kind: type) -> np.ndarray:
    """An array in memory, or in a file beyond HELD bytes."""
    return np.zeros(n, kind) if n * np.dtype(kind).itemsize <= HELD else np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def kinds(text: np.ndarray) -> np.ndarray:
    """1 where a suffix is smaller than its successor, 0 where it is larger, 2 at the end."""
    out = cells(len(text), np.uint8)
    after, hi = 1, len(text) - 1
    out[hi] = 2
    while hi > 0:  # from the end, in steps
        lo = max(0, hi - STEP)
        step = text[lo : hi + 1].astype(np.int64)
        sign = np.sign(step[1:] - step[:-1])
        at = np.where(sign != 0, np.arange(len(sign)), len(sign))
        at = np.minimum.accumulate(at[::-1])[::-1]
        known = np.append(sign, 1 if after else -1)[at]
        out[lo:hi] = known > 0
        after, hi = int(out[lo]), lo
    return out


def range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least values of ranges lo..hi, both ends included, by a table of powers of two."""
    levels = [values]
    while 1 << len(levels) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    size = hi - lo + 1
    k = np.frexp(size)[1] - 1
    out = np.empty(len(lo), values.dtype)
    for level in np.unique(k):
        own = np.flatnonzero(k == level)
        out[own] = np.minimum(levels[level][lo[own]], levels[level][hi[own] - (1 << level) + 1])
    return out


class Induction:
    """One upward and one downward pass over a text. ``depth`` 0 leaves common prefixes out."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, depth: int = 0) -> None:
        self.text, self.kind, self.depth = text, kind, depth
        self.low = np.full(int(text.max()) + 1, 255, np.uint8) if depth else None

    def _induce(self, queue: Tuples, pos: np.ndarray, lcp: np.ndarray, kind: int) -> None:
        """Push the predecessors of one kind; a common prefix grows by one symbol over the least one since the last push of that key."""
        before = pos - 1  # -1 is the end, of neither kind
        keep = np.flatnonzero(self.kind[before] == kind)
        if not len(keep):
            if self.depth:
                np.minimum(self.low, lcp.min(), out=self.low)
            return
        before = before[keep]
        key = self.text[before]
        order = np.argsort(key, kind="stable")
        key, before, at = key[order], before[order], keep[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(edge[1:], len(key))
        grown = np.zeros(len(key), np.uint8)
        if self.depth:
            first = np.concatenate([[0], at[:-1] + 1])
            first[edge] = 0
            least = range_least(lcp, first, at)
            names = key[edge]
            least[edge] = np.minimum(least[edge], self.low[names])
            grown = np.minimum(least.astype(np.uint16) + 1, self.depth).astype(np.uint8)
            np.minimum(self.low, lcp.min(), out=self.low)
            last = at[ends - 1] + 1
            tail = np.full(len(names), 255, np.uint8)
            inside = last < len(lcp)
            if inside.any():
                tail[inside] = range_least(lcp, last[inside], np.full(int(inside.sum()), len(lcp) - 1))
            self.low[names] = tail
        for k, lo, hi in zip(key[edge].tolist(), edge.tolist(), ends.tolist(), strict=True):
            queue.push(k, before[lo:hi], grown[lo:hi])

    def _seam(self, a: int, b: int) -> int:
        """The common prefix of two suffixes, up to ``depth``."""
        n = min(self.depth, len(self.text) - max(a, b))
        differ = np.flatnonzero(self.text[a : a + n] != self.text[b : b + n])
        return int(differ[0]) if len(differ) else n

    def run(self, seeds: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the largest to the smallest, each with its common prefix with the one given before it.

        ``seeds``: the positions of local minima in order, each with its common prefix with the one before.
        """
        up, down, larger = Tuples(), Tuples(), Tuples()
        key = self.text[seeds]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        own = {int(key[lo]): (lo, hi) for lo, hi in zip(edge, [*edge[1:], len(key)], strict=True)}
        todo = sorted(own, reverse=True)
        while todo or up.keys:
            c = min(todo[-1:] + up.keys[:1])
            if up.keys and up.keys[0] == c:
                heapq.heappop(up.keys)
            last = -1
            for pos, near in up.take(c):
                if last < 0:
                    near = near.copy()
                    near[0] = 0
                last = int(pos[-1])
                larger.push(c, pos, near)
                self._induce(up, pos, near, 0)
            if up.keys and up.keys[0] == c:
                heapq.heappop(up.keys)
            if todo and todo[-1] == c:
                todo.pop()
                lo, hi = own[c]
                for k in range(lo, hi, STEP):
                    pos, near = seeds[k : min(hi, k + STEP)], lcp[k : min(hi, k + STEP)].copy()
                    if k == lo:
                        near[0] = self._seam(last, int(pos[0])) if last >= 0 and self.depth else 0
                    self._induce(up, pos, near, 0)
        up.close()

        if self.depth:
            self.low[:] = 255
        keys = sorted(larger.pieces)
        waiting: list[int] = []
        seen: set[int] = set()
        while keys or waiting or down.keys:
            while down.keys:  # the heap is read from its other end here
                k = heapq.heappop(down.keys)
                if k not in seen:
                    seen.add(k)
                    heapq.heappush(waiting, -k)
            if not keys and not waiting:
                break
            c = max(keys[-1:] + ([-waiting[0]] if waiting else []))
            last = -1
            if waiting and -waiting[0] == c:
                heapq.heappop(waiting)
            for pos, near in down.take(c):
                if last < 0:
                    near = near.copy()
                    near[0] = 0
                last = int(pos[-1])
                yield pos, near
                self._induce(down, pos, near, 1)
            seen.discard(c)
            down.keys = [k for k in down.keys if k != c]
            heapq.heapify(down.keys)
            if keys and keys[-1] == c:
                keys.pop()
                held = None  # a tuple's prefix is the one with its lower neighbour, which comes after it here
                for pos, near in larger.take_back(c):
                    shifted = np.empty_like(near)
                    shifted[1:] = near[:-1]
                    shifted[0] = held if held is not None else self._seam(last, int(pos[0])) if last >= 0 and self.depth else 0
                    held, last = near[-1], int(pos[-1])
                    yield pos, shifted
                    self._induce(down, pos, shifted, 1)
        down.close()
        larger.close()
        yield np.array([len(self.text) - 1], np.int32), np.zeros(1, np.uint8)


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a sequence of names, to ``depth`` names, by doubling the length that ranks stand for."""
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names].astype(np.int64)
    todo = np.flatnonzero(counts[names] > 1)
    n, k = len(names), 1
    while len(todo) and k < depth:
        after = np.where(todo + k < n, rank[np.minimum(todo + k, n - 1)] + 1, 0)
        pair = rank[todo] * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        todo, pair = todo[order], pair[order]
        old = rank[todo]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        of_old = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(todo))
        start = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(of_old, at, 0))
        rank[todo] = old + start - group
        size = np.diff(np.append(np.flatnonzero(new), len(todo)))
        todo = todo[np.repeat(size, size) > 1]
        k *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes of a text of 16-bit symbols, up to ``depth``, four symbols at once."""
    whole = np.concatenate([text, np.zeros(4, np.uint16)])  # what follows the end is told apart by where it starts
    fours = np.ndarray((len(text),), np.uint64, whole, strides=(2,))
    out = np.full(len(a), depth, np.uint8)
    live, room = np.arange(len(a)), len(text) - np.maximum(a, b)
    for k in range(0, depth, 4):
        x = fours[np.minimum(a[live] + k, len(text) - 1)] ^ fours[np.minimum(b[live] + k, len(text) - 1)]
        at = np.flatnonzero((x != 0) | (room[live] <= k + 3))
        if len(at):
            y, own = x[at], live[at]
            same = np.zeros(len(at), np.int64)
            for n in range(1, 5):
                same += (y & np.uint64((1 << (16 * n)) - 1)) == 0
            out[own] = np.minimum(np.minimum(k + same, room[own]), depth)
            live = np.delete(live, at)
        if not len(live):
            break
    return out


def minima(text: np.ndarray, kind: np.ndarray, base: int, depth: int) -> np.ndarray:
    """The positions of the local minima in the order of their suffixes, to ``depth`` symbols."""
    least = cells(len(text), bool)
    least[1:] = (kind[1:] != 0) & (kind[:-1] == 0)
    least[-1] = True
    own = np.flatnonzero(least).astype(np.int32)
    by_symbol = own[np.argsort(text[own], kind="stable")]
    pieces = [pos[least[pos]] for pos, _ in Induction(text, kind).run(by_symbol, np.zeros(len(own), np.uint8))]
    order = np.concatenate(pieces)[::-1]
    # Equal substrings, from one minimum to the next, get equal names.
    number = cells(len(text), np.int32)
    number[own] = np.arange(len(own))
    place = number[order]
    size = np.diff(own, append=own[-1:])[place] + 1
    same = np.zeros(len(order), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    short = live[size[live] <= 254] if text.dtype == np.uint16 else live[:0]
    if len(short):
        same[short] = common_prefixes(text, order[short], order[short - 1], int(size[short].max())) >= size[short]
        live = live[size[live] > 254]
    k = 0
    while len(live):
        live = live[text[order[live] + k] == text[order[live - 1] + k]]
        k += 1
        done = size[live] == k
        same[live[done]] = True
        live = live[~done]
    names = np.empty(len(order), np.int64)
    names[place] = np.cumsum(~same) - 1
    return own[suffixes(names, base, -(-depth // 2))] if same.any() else order


def suffixes(names: np.ndarray, base: int, depth: int) -> np.ndarray:
    """The order of the suffixes of a sequence whose last name is its only smallest: recursion beyond ``base`` names."""
    if len(names) <= base or depth <= 1:
        return doubled(names, max(depth, 2))
    kind = kinds(names)
    order = minima(names, kind, base, depth)
    return np.concatenate([pos for pos, _ in Induction(names, kind).run(order, np.zeros(len(order), np.uint8))])[::-1].copy()


def sorted_suffixes(parts: list[bytes], depth: int, base: int = BASE) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Where each part begins in the text they make up, and all its suffixes from the largest to the smallest.

    Suffixes come in arrays of positions with their common prefix, up to ``depth`` (at most 254), with the suffix given before.
    """
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = cells(int(begin[-1]) + 1, np.uint16)
    for lo in range(0, len(parts), 4096):
        joined = np.frombuffer(b"\0".join(parts[lo : lo + 4096]), np.uint8)
        text[begin[lo] : begin[lo] + len(joined)] = joined + np.uint16(2)
    text[begin[1:] - 1] = BREAK
    text[-1] = END
    kind = kinds(text)
    order = minima(text, kind, base, depth)
    near = np.zeros(len(order), np.uint8)
    near[1:] = common_prefixes(text, order[:-1], order[1:], depth)
    return begin[:-1], Induction(text, kind, depth).run(order, near)


def later(sorted_: Iterator[tuple[np.ndarray, np.ndarray]], depth: int, keys: Callable[[np.ndarray], tuple[np.ndarray, ...]], valid: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """Positions of strings of ``depth`` symbols that also start at a place with a smaller key.

    Of each run of equal strings only those with the least key so far are held, so a run may be of any size.
    """
    held = np.empty(0, np.int32)
    for pos, near in sorted_:
        joined = np.concatenate([[True], near[1:] < depth])
        joined[0] = not (len(held) and near[0] >= depth)
        group = np.cumsum(joined)  # 0: the run that began in an earlier step
        if joined[0]:
            held = np.empty(0, np.int32)
        keep = np.flatnonzero(valid(pos))
        whole, of = np.concatenate([held, pos[keep]]), np.concatenate([np.zeros(len(held), np.int64), group[keep]])
        last = int(group[-1]) if len(group) else 0
        count = np.bincount(of, minlength=last + 1)
        many = np.flatnonzero((count[of] > 1) | (of == last))
        whole, of = whole[many], of[many]
        own = keys(whole)
        order = np.lexsort((*reversed(own), of))
        whole, of, own = whole[order], of[order], [k[order] for k in own]
        if not len(whole):
            held = np.empty(0, np.int32)
            continue
        first = np.concatenate([[True], of[1:] != of[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        least = np.all([k == k[at] for k in own], axis=0)
        yield whole[~least]
        held = whole[least & (of == last)]
