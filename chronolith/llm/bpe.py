"""Byte-level BPE, encoded and decoded by our own merges over a pair occurrence index.

The distinct pre-tokens of a partition are laid end to end, some hundred thousand characters of texts at a time so that
memory stays bounded. An index maps every adjacent pair that has a merge rank to all its positions; active ranks leave a heap in ascending order, all positions of the
pair are merged from left to right, and the lists of the pairs around each merge are updated. A merge
makes only pairs of higher rank, so one ascending sweep gives what merging word by word gives.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, batches_of, cuts_of, table, worker_slot

#: The pre-tokenizer's pattern; \s there is Unicode white space, which \s of Python is not quite.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Unicode's white space, and with it what follows: no pre-token reaches over the end of such a segment.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str, to_encode: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(chars[c] for c in piece) for piece, i in ids.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        if not to_encode:
            return
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = ids[c]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}

    def text_of(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids))).decode("utf-8", "replace")


def merge_all(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    merges = vocabulary.merges
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.full(int(sizes.sum()) + len(words), -1, np.int64)  # -1 ends a word, and no pair reaches over it
    of = np.repeat(np.arange(len(words)), sizes)
    flat[np.arange(len(of)) + of] = np.array(vocabulary.byte_id)[np.frombuffer(b"".join(words), np.uint8)]
    symbol = flat.tolist()
    after = list(range(1, len(symbol) + 1))
    before = list(range(-1, len(symbol) - 1))
    positions: dict[tuple[int, int], list[int]] = {}
    active: list[tuple[int, tuple[int, int], int]] = []
    # The index at first: places sorted by their pair.
    code = (flat[:-1] << 32) | (flat[1:] & 0xFFFFFFFF)
    order = np.argsort(code, kind="stable")
    for lo, hi in cuts_of(code[order]):
        pair = (symbol[order[lo]], symbol[order[lo] + 1])
        if found := merges.get(pair):
            positions[pair] = order[lo:hi].tolist()
            heapq.heappush(active, (found[0], pair, found[1]))
    where, rank_of = positions.get, merges.get
    while active:
        _, (left, right), new = heapq.heappop(active)
        places = positions.pop((left, right))
        places.sort()
        for at in places:
            nxt = after[at]
            if symbol[at] != left or symbol[nxt] != right:
                continue  # an earlier merge took one of the two
            symbol[at], symbol[nxt] = new, -2
            after[at] = end = after[nxt]
            before[end] = at
            start = before[at]  # before the first word stands the last one's end
            for pair, place in (((new, symbol[end]), at), ((symbol[start], new), start)):
                if (own := where(pair)) is not None:
                    own.append(place)
                elif (found := rank_of(pair)) is not None:
                    positions[pair] = [place]
                    heapq.heappush(active, (found[0], pair, found[1]))
    flat = np.array(symbol, np.int64)
    live = flat >= 0
    ids = flat[live].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(np.cumsum(flat == -1)[live], minlength=len(words))) * 4
    return [ids[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Encodes texts, remembering the ids of segments and pre-tokens in a memory bounded by bytes; a pre-token is its own only one."""

    #: Bytes of the memory, and characters of texts that are learned from at once.
    LIMIT, BATCH = 200_000_000, 500_000

    def __init__(self, path: str) -> None:
        import regex

        self.vocabulary = Vocabulary(path)
        self.pattern, self.segment = regex.compile(PATTERN), re.compile(SEGMENT)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.ids = Memo(self.LIMIT)

    def _learn(self, segments: set[str]) -> None:
        ids = self.ids
        split = {s: self.pattern.findall(s) for s in segments}
        words = list({w for own in split.values() for w in own if w not in ids})
        ids.learn(words, merge_all([w.encode() for w in words], self.vocabulary))
        rest = [s for s in segments if s not in ids]
        ids.learn(rest, [b"".join([ids[w] for w in split[s]]) for s in rest])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for part in batches_of(texts, self.BATCH):
            self.ids.tidy()
            get, new, found = self.ids.get, set(), []
            for text in texts[part]:
                own = []
                for kind, stretch in self._parts(text):
                    segments = [] if kind is not None else self.segment.findall(stretch)
                    ids = list(map(get, segments)) if kind is None else [struct.pack("<I", kind)]
                    if missing := None in ids:
                        new.update(s for s, i in zip(segments, ids, strict=True) if i is None)
                    own.append((ids, segments if missing else None))
                found.append(own)
            self._learn(new)
            get = self.ids.__getitem__
            for own in found:
                yield b"".join(b"".join(ids if segments is None else map(get, segments)) for ids, segments in own)

    def _parts(self, text: str) -> list[tuple[int | None, str]]:
        """Stretches of ordinary text (kind None) and special tokens (kind: their id)."""
        ids = self.vocabulary.special
        if self.special is None or not any(s in text for s in ids):
            return [(None, text)]
        return [(ids.get(p), p) for p in self.special.split(text) if p]


def encoder(path: str) -> Encoder:
    return worker_slot(f"bpe:{path}", lambda: Encoder(path))


#: Characters of the texts that an operator gives back at once.
GIVEN = 2_000_000


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the ids of every whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Ids may be null or repeat: rows are independent. Strings of special
    tokens inside a text are encoded as those tokens, as the public library does by default. An empty table gives
    an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b["text"].tolist()
            for part in batches_of(texts, GIVEN):
                yield pd.DataFrame({id_col: b[id_col].iloc[part], "ids": list(enc.encode(texts[part]))})

    return _rows(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids, text``: the text of every row of ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. Null ids give the empty text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = worker_slot(f"bpe-decode:{tokenizer}", lambda: Vocabulary(tokenizer, to_encode=False))
        for b in batches:
            ids = [x or b"" for x in b["ids"]]
            for part in batches_of(ids, 4 * GIVEN):
                yield pd.DataFrame({id_col: b[id_col].iloc[part], "ids": ids[part], "text": list(map(vocabulary.text_of, ids[part]))})

    return encoded.select(id_col, "ids").mapInPandas(run, f"`{id_col}` long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, text``: what ``decode`` gives for what ``encode`` gives, in one pass with one vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b["text"].tolist()
            for part in batches_of(texts, GIVEN):
                ids = list(enc.encode(texts[part]))
                yield pd.DataFrame({id_col: b[id_col].iloc[part], "ids": ids, "text": list(map(enc.vocabulary.text_of, ids))})

    return _rows(docs, id_col, text_col).mapInPandas(run, f"`{id_col}` long, ids binary, text string")


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(table(spark, sf_dir, "documents"), tokenizer).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
