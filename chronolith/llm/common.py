"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    Only a local master that has neither gets a folder of its own; on a cluster executors would write where nobody reads.
    """
    global _own_dir
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="chronolith-")
    return _own_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage, survives lost executors, and gives the planner true file sizes,
    so that it broadcasts the table only where it is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of the input's size, from file sizes; no job runs. None where nothing is known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """A partition count that follows the input, at least the session's own."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(input_bytes(df) or 0) // bytes_each))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fixed folds of the labelled tables."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def id_remainder_of(doc_id: int, divisor: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % divisor


def sample_by_hash(rows: DataFrame, id_col: str, class_col: str, sample: int) -> DataFrame:
    """About ``sample`` rows of every class, whole classes if they have no more, chosen by the hash of their id.

    Only the classes are counted; no class meets in one task. A class's share is what ``sample`` is of its rows, so the number
    varies by a few of its square root.
    """
    counts = written(rows.groupBy(F.col(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_n")), "sample-classes")
    return rows.join(counts, rows[class_col] == counts["_class"]).where(in_sample(F.col(id_col), F.col("_n"), sample)).select(*rows.columns)


def in_sample(id_: Column, n: Column, sample: int) -> Column:
    """Whether an id's hash lies in the share that ``sample`` is of ``n`` rows; in doubles, as any number of rows may be counted."""
    return F.pmod(F.xxhash64(id_, F.lit("sample")), F.lit(1 << 40)).cast("double") * n < float(sample) * (1 << 40)


#: Odd 64-bit multipliers, fixed so that every worker and every run agrees.
_ODD = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive word hashes; empty where there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m] * _ODD[0]
    for i in range(1, n):
        out += words[i : i + m] * _ODD[i]
    return mixed(out)


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit number for every byte, 0 for white space; with ``lower`` A-Z have those of a-z."""
    out = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        out[65:91] = out[97:123]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Two independent hash functions of words: their byte values, as they are and lowered, their odd bases, and powers of these.
_SEEDS, _BASES = (20240301, 20240302), (0x9E3779B97F4A7C17, 0xD1B54A32D192ED03)
_VALUES = {(k, lower): _byte_values(seed, lower) for k, seed in enumerate(_SEEDS) for lower in (False, True)}
_powers: dict[int, list[np.ndarray]] = {}
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 20


def _powers_to(k: int, n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if k not in _powers or len(_powers[k][0]) < n:
        _powers[k] = []
        for base in (_BASES[k], pow(_BASES[k], -1, 2**64)):
            factors = np.full(n, np.uint64(base))
            factors[0] = 1
            _powers[k].append(np.multiply.accumulate(factors))
    return _powers[k]


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[slice, list[str]]]:
    """Slices of about ``size`` bytes of a batch's texts, of one text at least; only a slice becomes Python strings. Null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield slice(lo, hi), [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def cuts_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    if not len(keys):
        return []
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(edge[:-1], edge[1:], strict=True))


class WordBatch:
    """64-bit hashes of all words of some texts, and where each text's words begin.

    Words are what ASCII white space parts. A word's hash is a polynomial of its bytes, taken from prefix sums over
    a segment of the batch, so that no word becomes an object. ``again`` gives a second, independent hash of every word.
    """

    def __init__(self, texts: list[str], lower: bool = False) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        self.lower, self.data = lower, np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.hashes = self._hashed(0)
        begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        self.first = np.searchsorted(self.start, begin)

    def _hashed(self, k: int) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):  # words that begin in one segment
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.start, base + SEGMENT)))
            data = self.data[base : self.end[hi - 1]]
            powers, inverse = _powers_to(k, len(data) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[k, self.lower][data] * powers[: len(data)])])
            a, b = self.start[lo:hi] - base, self.end[lo:hi] - base
            out[lo:hi] = (sums[b] - sums[a]) * inverse[a]
            lo = hi
        return mixed(out)

    def again(self) -> np.ndarray:
        return self._hashed(1)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, the text of each and its place there."""
        of = self.text_of_word()
        inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.empty(0, np.int64)
        text = of[inside]
        return gram_hashes(self.hashes, n)[inside] if len(inside) else np.empty(0, np.uint64), text, inside - self.first[text]


def batches_of(texts: list[str], characters: int = 1_000_000) -> list[slice]:
    """Slices of about so many characters, of one text at least."""
    out, lo, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > characters:
            out.append(slice(lo, k))
            lo, size = k, 0
        size += len(t)
    return [*out, slice(lo, len(texts))] if len(texts) > lo else out


_slot: dict[str, Any] = {}


def worker_slot(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this Python worker for its next tasks, until a function asks for another key.

    Spark reuses workers across stages: a worker that kept a model and a memory for every operator would grow with their number.
    """
    if key not in _slot:
        release()
        _slot[key] = make()
    return _slot[key]


def release() -> None:
    """Forget what earlier stages left in this worker, and give the memory back."""
    if _slot:
        _slot.clear()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass  # another C library


class Memo(dict):
    """What strings map to, forgotten as a whole once keys and values take about ``limit`` bytes."""

    #: What an entry takes besides its characters.
    ENTRY = 200

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.bytes = limit, 0

    def tidy(self) -> None:
        """Called between texts, so that what one of them looks up is there."""
        if self.bytes > self.limit:
            self.clear()
            self.bytes = 0

    def learn(self, keys: list[str], values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.bytes += self.ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))
