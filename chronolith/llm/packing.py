"""Packing tokenized documents into sequences by best-two-fit.

Only lengths matter to a packing, so a shard of pieces is packed on its histogram of lengths. A bin
is filled greedily, always with the largest unpacked piece that fits; then its smallest piece is
replaced by the two unpacked pieces that fill the gap it leaves most tightly, if they fill it better.
Shards hold some tens of thousands of pieces, dealt by hash: packing them apart costs at most
about one open bin each, and no task sees more, however large the input.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, batches_of, table, worker_slot, written

#: Pieces a shard has about.
SHARD = 20_000
#: What ends every document.
END = b"\x00\x00\x00\x00"


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths (each at most ``capacity`` together) and how often each is used; uses up all lengths."""
    left = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    out: list[tuple[list[int], int]] = []
    index = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(left > 0, index, 0))  # the largest length left, up to each

    def take(x: int, n: int = 1) -> None:
        left[x] -= n
        if left[x] == 0 or n < 0:
            at = x
            end = at + 1
            if left[x] > 0:
                while end <= capacity and below[end] < x:
                    end += 1
                below[at:end] = x
            else:
                low = below[at - 1] if at else 0
                while end <= capacity and below[end] == x:
                    end += 1
                below[at:end] = low

    while (x := int(below[capacity])) > 0:
        bin_, gap = [], capacity
        while x > 0:
            bin_.append(x)
            take(x)
            gap -= x
            x = int(below[gap])
        if gap and len(bin_) > 0:
            small = bin_[-1]
            room = gap + small
            a = index[1 : room // 2 + 1][left[1 : room // 2 + 1] > 0]
            if len(a):
                b = below[room - a]
                b = np.where((b == a) & (left[a] < 2), below[a - 1], b)
                both = np.where(b > 0, a + b, 0)
                best = int(np.argmax(both))
                if both[best] > small:
                    take(small, -1)
                    bin_[-1:] = sorted((int(a[best]), int(b[best])), reverse=True)
                    for y in bin_[-2:]:
                        take(y)
        times = 1
        need = {y: bin_.count(y) for y in bin_}
        if (more := min(int(left[y]) // n for y, n in need.items())) > 0:  # the same bin again, while all its lengths last
            times += more
            for y, n in need.items():
                take(y, n * more)
        out.append((bin_, times))
    return out


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its bin and its offset there."""
    order = np.argsort(lengths, kind="stable")
    next_of = np.searchsorted(lengths[order], np.arange(capacity + 2))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    for pattern, times in best_two_fit(lengths, capacity):
        for _ in range(times):
            at = 0
            for x in pattern:
                piece = order[next_of[x]]
                next_of[x] += 1
                bins[piece], offsets[piece] = number, at
                at += x
            number += 1
    return bins, offsets


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: its own where that can be printed, or one after all bytes."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}


class Tokens:
    """Ids of texts by a public byte-level tokenizer whose pre-tokens never hold white space; chunks are remembered, in bounded memory."""

    #: Bytes of the memory of chunks and words.
    LIMIT = 200_000_000
    #: Characters of texts that are looked up at once: so few that what the first look met is still at hand for the second.
    STEP = 50_000
    #: Letters below this one are composed, and lowered alike by all; words of them are what the tokenizer's model gets.
    BEYOND_LATIN = "\u0250"
    LETTERS = byte_letters()
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A text with one of these goes to the tokenizer whole: special tokens, what only Python's split takes for white
        # space, and the letter whose lower case Python chooses by its place in a word.
        self.odd = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), "\x1c", "\x1d", "\x1e", "\x1f", "Σ"]
        self.words = regex.compile(self.WORDS)
        self.memo = Memo(self.LIMIT)

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of lowered words, each a pre-token by itself if it is Latin: the model gets it as it is, which takes a third of the time."""
        tokenize, out, others = self.tokenizer.model.tokenize, [], []
        for k, w in enumerate(words):
            if not (w.isascii() and w.isprintable()):
                if max(w) >= self.BEYOND_LATIN:
                    others.append(k)
                    out.append(b"")
                    continue
                w = w.encode().decode("latin-1").translate(self.LETTERS)
            out.append(array("I", [t.id for t in tokenize(w)]).tobytes())
        for k, ids in zip(others, self._plain([words[k] for k in others]), strict=True):
            out[k] = ids
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Chunks by their words, so that punctuation around a word makes nothing new; composed characters only.

        A word by itself is a chunk like any other, so both are remembered together.
        """
        memo, new, split = self.memo, set(), {}
        for c in chunks:
            if not c.isascii():
                own = self.words.findall(c) if is_normalized("NFC", c) else [c]
            elif c.isalpha():
                own = [c]
            elif (head := c[:-1]).isalpha() and not c[-1].isalnum():  # the most common kind
                own = [head, c[-1]]
            else:
                own = self.words.findall(c)
            if own == [c]:
                new.add(c)
            else:
                split[c] = own
                new.update([w for w in own if w not in memo])
        words = list(new)
        memo.learn(words, self._of_words(words))
        memo.learn(list(split), [b"".join(map(memo.__getitem__, own)) for own in split.values()])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for part in batches_of(texts, self.STEP) for ids in self._encode(texts[part])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        self.memo.tidy()
        new, split = set(), []
        for text in texts:
            split.append(chunks := None if any(map(text.__contains__, self.odd)) else text.lower().split())
            new.update(filterfalse(self.memo.__contains__, chunks or ()))
        self._learn(list(new))
        get = self.memo.__getitem__
        return [self._plain([text])[0] if chunks is None else b"".join(map(get, chunks)) for text, chunks in zip(texts, split, strict=True)]


def tokens(path: str) -> Tokens:
    return worker_slot(f"packing:{path}", lambda: Tokens(path))


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: ``id_col, piece, start, length, ids_crc32`` and, if asked, ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokens(tokenizer)
        step = capacity * 4
        for b in batches:
            texts, ids = b["text"].tolist(), b[id_col].tolist()
            for part in batches_of(texts):
                rows = []
                for doc, own in zip(ids[part], tok.encode(texts[part]), strict=True):
                    own += END
                    for piece, at in enumerate(range(0, len(own), step)):
                        cut_ids = own[at : at + step]
                        rows.append((doc, piece, at // 4, len(cut_ids) // 4, zlib.crc32(cut_ids), cut_ids))
                out = pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", "ids"])
                out[id_col] = out[id_col].astype("Int64")
                yield out if with_ids else out.drop(columns="ids")

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of ``cut`` with ``sequence_id`` and ``offset``: the packed sequences, gapless from 0.

    Null and empty texts are a document of the end id alone. Repeated rows and null ids are packed like any
    others. An empty table gives an empty result; other columns are ignored.
    """
    pieces = written(cut(docs, tokenizer, capacity, id_col, text_col, with_ids), "packing-pieces")
    shards = max(1, round(pieces.count() / SHARD))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = place(b["length"].to_numpy(), capacity)
        shard = int(b["shard"].iloc[0])
        return b.drop(columns="shard").assign(sequence_id=bins + (shard << 32), offset=offsets)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(shards)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or word_tokenizer())
